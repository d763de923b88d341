"""Sums of money in free text: the quantity and the unit they are stated in.

A sum may be a number in any notation or spelled out, with its scale and currency before or after it, in the currency
column, or in a note that says nothing but a unit. Hedges, a year, a number of investors or a valuation beside the
sum don't count. Texts are parsed whole; a null, blank or wordy amount states no sum.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and signs of currencies and scales. Of a word that several countries use, the currency is the
# one that it can stand for among those with a rate.
CURRENCY_WORDS = {
    "USD": ["usd", "us$", "$", "dollar", "dollars", "us dollar", "us dollars", "u.s. dollars", "american dollars", "buck", "bucks"],
    "EUR": ["eur", "€", "euro", "euros"],
    "GBP": ["gbp", "£", "pound", "pounds", "pound sterling", "pounds sterling", "sterling", "quid"],
    "INR": ["inr", "₹", "rs", "rs.", "rupee", "rupees", "indian rupees", "indian rupee"],
    "JPY": ["jpy", "¥", "jp¥", "円", "yen", "japanese yen"],
    "CHF": ["chf", "fr", "fr.", "sfr", "sfr.", "franc", "francs", "swiss franc", "swiss francs", "franken"],
    "SEK": ["sek", "kr", "kr.", "krona", "kronor", "kronas", "crown", "crowns", "swedish krona", "swedish kronor"],
    "BRL": ["brl", "r$", "real", "reais", "reals", "brazilian real", "brazilian reais"],
}
SCALE_WORDS = {
    "k": ["k", "thsd", "thsd.", "tsd", "tsd.", "thousand", "thousands", "tausend", "mil", "mille", "'000", "000s"],
    "lakh": ["lakh", "lakhs", "lac", "lacs"],
    "m": ["m", "mm", "mn", "mln", "mln.", "mio", "mio.", "mill", "mill.", "million", "millions", "millionen", "millones", "milhões", "1,000,000"],
    "crore": ["cr", "cr.", "crore", "crores"],
    "b": ["b", "bn", "bln", "bil", "billion", "billions", "mrd", "mrd.", "milliarde", "milliarden"],
    "t": ["tn", "trn", "trillion", "trillions"],
}
#: Scales that are counted in one currency only.
SCALE_CURRENCY = {"lakh": "INR", "crore": "INR"}
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {
    w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)
}
NOTE_FILLERS = set("all amounts amount are is given stated in as figures figure sheet values value unit units of the reported one = : ( ) , .".split())

CURRENCIES = {w: c for c, ws in CURRENCY_WORDS.items() for w in ws}
SCALES = {w: s for s, ws in SCALE_WORDS.items() for w in ws}
GLUED = {f"{s}{c.lower()}": (s, c) for s in ("k", "m", "b") for c in CURRENCY_WORDS} | {f"m{sign}": ("m", CURRENCIES[sign]) for sign in "€$£¥₹"} | {f"k{sign}": ("k", CURRENCIES[sign]) for sign in "€$£¥₹"}
_longest = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
_word_end = r"(?![^\W\d_])"
UNIT = re.compile(rf"(?P<glued>(?:{_longest(GLUED)}){_word_end})|(?P<currency>(?:{_longest(CURRENCIES)})(?:{_word_end}|(?<=[$€£¥₹円])))|(?P<scale>(?:{_longest(SCALES)})(?:{_word_end}|(?<=\d)))")
NUMBER = re.compile(r"\d{1,3}(?:[ '’]\d{3})+(?:[.,]\d+)?|\d[\d.,]*\d|\d")
WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
NOT_A_SUM = re.compile(r"^\s*(?:investors?|backers?|people|users?|tranches?|years?|rounds?)\b|^[^,;\d]{0,25}\bvaluation\b")
BEFORE_YEAR = re.compile(r"\b(?:in|since|of|by|year|fy)\s*$")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    return re.sub(r"\s+", " ", re.sub(r"[​-‍﻿]", "", text)).strip()


def read_number(digits: str, scaled: bool, beside: bool) -> Decimal:
    """The value of a run of digits with any separators.

    ``scaled``: there is a scale, so a lone point is a decimal one; ``beside``: it stands at the number itself, so a
    lone comma is a decimal one too unless the number is a round one.
    """
    s = re.sub(r"[ '’]", "", digits)
    points, commas = s.count("."), s.count(",")
    if points and commas:
        mark = max(".", ",", key=s.rfind)
        s = s.replace("," if mark == "." else ".", "").replace(mark, ".")
    elif points > 1 or commas > 1:
        s = s.replace(".", "").replace(",", "")
    elif commas:
        whole, _, part = s.partition(",")
        s = whole + part if len(part) == 3 and whole != "0" and (not beside or len(whole) <= 3 and digits[-3:] == "000") else f"{whole}.{part}"
    elif points and not scaled:
        whole, _, part = s.partition(".")
        s = whole + part if len(part) == 3 and whole != "0" else s
    return Decimal(s or "0")


def _units_at(text: str, pos: int, *, back: bool) -> tuple[str | None, str | None]:
    """Scale and currency that stand directly after (or before) a position."""
    scale = currency = None
    if back:
        for start in range(max(0, pos - 24), pos):
            piece = text[start:pos].strip()
            if (start and text[start - 1].isalpha() and text[start].isalpha()) or not piece:
                continue
            found = _all_units(piece)
            if found:
                return found
        return None, None
    while m := UNIT.match(text, pos + len(text[pos:]) - len(text[pos:].lstrip(" -"))):
        if m["glued"]:
            s, c = GLUED[m["glued"]]
        else:
            s, c = SCALES.get(m["scale"] or ""), CURRENCIES.get(m["currency"] or "")
        if (s and scale) or (c and currency):
            break
        scale, currency, pos = scale or s, currency or c, m.end()
        if pos < len(text) and text[pos] == "." :
            pos += 1
    return scale, currency


def _all_units(piece: str) -> tuple[str | None, str | None] | None:
    """Scale and currency of a piece that consists of them only."""
    scale = currency = None
    pos = 0
    while pos < len(piece):
        m = UNIT.match(piece, pos)
        if not m:
            return None
        s, c = GLUED[m["glued"]] if m["glued"] else (SCALES.get(m["scale"] or ""), CURRENCIES.get(m["currency"] or ""))
        if (s and scale) or (c and currency):
            return None
        scale, currency, pos = scale or s, currency or c, m.end()
        while pos < len(piece) and piece[pos] in " .-":
            pos += 1
    return scale, currency


def note_unit(note: str | None) -> tuple[str | None, str | None]:
    """Scale and currency of a note that states a unit and nothing else."""
    text = _plain(note or "")
    scale = currency = None
    pos = 0
    while pos < len(text):
        if text[pos] == " ":
            pos += 1
            continue
        m = UNIT.match(text, pos)
        if m and not (m["glued"] is None and m["scale"] == "m" and text[m.end() : m.end() + 1].isalpha()):
            s, c = GLUED[m["glued"]] if m["glued"] else (SCALES.get(m["scale"] or ""), CURRENCIES.get(m["currency"] or ""))
            if (s and scale) or (c and currency):
                return None, None
            scale, currency, pos = scale or s, currency or c, m.end()
            continue
        w = re.match(r"[a-z]+|[^\w\s]", text[pos:])
        if not w or w[0] not in NOTE_FILLERS:
            return None, None
        pos += w.end()
    return scale, currency


def _spelled(text: str) -> tuple[Decimal, str | None, str | None] | None:
    """A sum in words, as ``two and a half million dollars``."""
    words = [w for part in WORD.findall(text) for w in part.split("-")]
    total, current, seen, scale = Decimal(0), Decimal(0), False, None
    i = 0
    while i < len(words):
        w = words[i]
        if w in NUMBER_WORDS:
            current, seen = current + NUMBER_WORDS[w], True
        elif w == "hundred" and seen:
            current *= 100
        elif w == "half":
            current, seen = current + Decimal("0.5"), True
            i += words[i + 1 : i + 2] == ["a"]
        elif w in ("a", "an") and not seen and words[i + 1 : i + 2] and words[i + 1] in {"million", "billion", "thousand", "hundred", "lakh", "crore"}:
            current, seen = Decimal(1), True
        elif w == "quarter":
            current, seen = current + Decimal("0.25"), True
            i += words[i + 1 : i + 2] == ["of"]
            i += words[i + 1 : i + 2] == ["a"]
        elif seen and SCALES.get(w) and len(w) > 2:
            total, current, scale = total + current * 10 ** {"k": 3, "lakh": 5, "m": 6, "crore": 7, "b": 9, "t": 12}[SCALES[w]], Decimal(0), SCALES[w]
        elif seen and w in ("and", "a"):
            pass
        elif seen:
            break
        i += 1
    if not seen:
        return None
    rest = " ".join(words[i:])
    currency = next((c for w, c in sorted(CURRENCIES.items(), key=lambda x: -len(x[0])) if w.isalpha() and len(w) > 2 and re.search(rf"\b{w}\b", rest)), None) or SCALE_CURRENCY.get(scale or "")
    return total + current, "", currency


@lru_cache(maxsize=100_000)
def parse(amount: str | None, currency: str | None, note: str | None) -> tuple[str, str] | None:
    """(quantity, unit) of the sum that an amount states, or None; the unit is as in ``units.money_graph``."""
    text = _plain(amount or "")
    given = CURRENCIES.get(_plain(currency or ""))
    best = None
    for m in NUMBER.finditer(text):
        if m.start() and text[m.start() - 1].isalpha() and text[m.start() - 1 : m.start() + 1].isalnum() and _units_at(text, m.start(), back=True) == (None, None):
            continue
        s1, c1 = _units_at(text, m.start(), back=True)
        s2, c2 = _units_at(text, m.end(), back=False)
        after = text[m.end() :]
        if NOT_A_SUM.match(after):
            continue
        bare = not (s1 or s2 or c1 or c2)
        if bare and re.fullmatch(r"(?:19|20)\d\d", m[0]) and (BEFORE_YEAR.search(text[: m.start()]) or best):
            continue
        scale, unit = s2 or s1, c1 or c2
        if best is None or (best[3] and not bare):
            best = m[0], scale, unit, bare
        if not bare:
            break
    if best:
        digits, scale, unit, _ = best
        value = None
    else:
        words = _spelled(text)
        if not words:
            return None
        value, scale, unit = words
    note_scale, note_currency = note_unit(note)
    if value is None:
        beside = scale is not None
        scale = scale or note_scale
        value = read_number(digits, scale is not None, beside)
    unit = unit or given or note_currency or SCALE_CURRENCY.get(scale or "") or "USD"
    return f"{value:f}", f"{scale} {unit}" if scale else unit


@F.pandas_udf(T.StructType([T.StructField("quantity", T.StringType()), T.StructField("unit", T.StringType())]))
def _parsed(amount: pd.Series, currency: pd.Series, note: pd.Series) -> pd.DataFrame:
    none = lambda s: s.astype(object).where(s.notna(), None)
    found = [parse(*row) or (None, None) for row in zip(none(amount), none(currency), none(note))]
    return pd.DataFrame(found, columns=["quantity", "unit"])


def stated_sum(amount: Column, currency: Column, note: Column) -> Column:
    """The struct of quantity and unit; both null where no sum is stated."""
    return _parsed.asNondeterministic()(amount, currency, note)  # else a filter on the result would run it twice
