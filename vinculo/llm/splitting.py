"""Splitting oversized texts at natural boundaries (problem 3), by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint; halves still above the limit minus the
overlap are cut again; then each piece but the first is preceded by the end of the text before it, at most ``overlap``
characters, beginning at a boundary where one is near. Boundaries, strongest first: a blank line, a line end, the end
of a sentence, a blank; only where a stretch has none is it cut between two characters, and then never inside a pair
of line-end characters or before a combining mark or joined emoji.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6_000, 300
#: A cut is sought in the middle of the text first, then in all of it that leaves each part a tenth.
WINDOWS = (0.15, 0.40)
BOUNDARIES = [
    re.compile(r"\n[ \t]*\r?\n\s*|\r[ \t]*\r\s*"),
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+[」』）]*"),
    re.compile(r"\s+|、"),
]


def _attached(text: str, i: int) -> bool:
    """Whether a cut before character i would part what belongs together."""
    c = text[i]
    return (text[i - 1] == "\r" and c == "\n") or unicodedata.combining(c) != 0 or c in "‍️︎" or text[i - 1] == "‍" or 0x1F3FB <= ord(c) <= 0x1F3FF


def find_cut(text: str, start: int, end: int) -> int:
    """The position of the strongest boundary near the middle of text[start:end]."""
    middle, size = (start + end) // 2, end - start
    for window in WINDOWS:
        low, high = max(start + 1, middle - int(window * size)), min(end - 1, middle + int(window * size))
        for boundary in BOUNDARIES:
            places = [m.end() for m in boundary.finditer(text, low, high)]
            places = [p for p in places if low <= p <= high and not _attached(text, p)]
            if places:
                return min(places, key=lambda p: (abs(p - middle), p))
    for d in range(size // 2):
        for p in (middle - d, middle + d):
            if start < p < end and not _attached(text, p):
                return p
    return middle


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Where the text is parted; each part fits the limit less the overlap, the first the limit itself."""
    todo, ends = [(0, len(text))], []
    while todo:
        start, end = todo.pop()
        if end - start <= (limit - overlap if start else limit):
            ends.append(end)
        else:
            cut = find_cut(text, start, end)
            todo += [(cut, end), (start, cut)]
    return ends


def overlap_start(text: str, at: int, overlap: int) -> int:
    """Where the repeated end begins: up to ``overlap`` characters back, moved on to a boundary in the first third of them."""
    low = max(0, at - overlap)
    for boundary in BOUNDARIES[1:]:
        for m in boundary.finditer(text, max(0, low - 2), low + overlap // 3):
            if low <= m.end() < at and not _attached(text, m.end()):
                return m.end()
    while low < at and low and _attached(text, low):
        low += 1
    return low


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start of what is new, end) of each piece; one piece for a text within the limit."""
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must be larger than the overlap")
    pieces, start = [], 0
    for end in cuts(text, limit, overlap):
        pieces.append((overlap_start(text, start, overlap) if start else 0, start, end))
        start = end
    return pieces


def split(df: DataFrame, id_col: str, text_col: str, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id_col, piece_no, n_pieces, start, new_start, piece`` for each row; positions in characters from 0.

    Null and empty texts give no piece, a text within the limit one piece equal to it. Repeated rows are each split.
    Without the overlaps the pieces are the text, character for character. Only texts above the limit reach Python.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece_no int, n_pieces int, start int, new_start int, piece string"
    rows = df.select(F.col(id_col), F.col(text_col).alias("text")).where(F.length("text") > 0)
    whole = rows.where(F.length("text") <= limit).select(id_col, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), F.lit(0).alias("new_start"), F.col("text").alias("piece"))

    def run(batches):
        for pdf in batches:
            for key, text in zip(pdf[id_col], pdf["text"]):
                pieces = split_text(text, limit, overlap)
                n = len(pieces)
                yield pd.DataFrame([(key, i, n, a, b, text[a:c]) for i, (a, b, c) in enumerate(pieces)], columns=[id_col, "piece_no", "n_pieces", "start", "new_start", "piece"])

    return whole.unionByName(rows.where(F.length("text") > limit).mapInPandas(run, schema))


def oversized(df: DataFrame, id_col: str, text_col: str, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The ids whose text had to be cut, once each."""
    return split(df, id_col, text_col, limit=limit, overlap=overlap).where("n_pieces > 1").select(id_col).distinct()
