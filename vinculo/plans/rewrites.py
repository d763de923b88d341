"""Rewrites of question and query texts before they are read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lowering import MAX_RESULTS
from .tokens import tokenize

# The seasons of batches by their letters.
SEASONS = {"w": "Winter", "s": "Summer"}


def expand_batches(question: str) -> str:
    """``W23`` and ``s09`` as ``Winter 2023`` and ``Summer 2009``."""
    return re.sub(r"\b([WS])(\d{2})\b", lambda m: f"{SEASONS[m[1].lower()]} 20{m[2]}", question, flags=re.I)


def expand_batches_column(c: Column) -> Column:
    for letter, season in SEASONS.items():
        c = F.regexp_replace(c, rf"(?i)\b{letter}(\d{{2}})\b", f"{season} 20$1")
    return c


def strip_fences(text: str) -> str:
    """A query text without the fences of a code block."""
    return re.sub(r"```(?:cypher)?", "", text).strip()


def strip_fences_column(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"```(?:cypher)?", ""), r"^\s+|\s+$", "")


def cap_results(text: str, most: int = MAX_RESULTS) -> str:
    """The query with its last LIMIT lowered to ``most``, or with such a LIMIT added; inner LIMITs stay."""
    text = text.rstrip().rstrip(";").rstrip()
    tokens = tokenize(text)
    if len(tokens) > 1 and tokens[-1].kind == "number" and tokens[-2].text.upper() == "LIMIT":
        return f"{text[: tokens[-2].start]}LIMIT {min(int(tokens[-1].value), most)}"
    return f"{text}\nLIMIT {most}"
