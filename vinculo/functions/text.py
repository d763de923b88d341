"""Scalar functions on names and texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two names of one category, its label, and the result columns that hold categories.
AI_ALIASES = ("ai", "artificial intelligence")
AI_LABEL = "Artificial Intelligence"
CATEGORY_FIELDS = frozenset({"category", "categories", "industry", "industries", "technology", "technologies"})
# The usual parameters of the similarity.
BOOST_FROM, PREFIX_WEIGHT, PREFIX_LENGTH = 0.7, 0.1, 4


def jaro(a: str, b: str) -> float:
    """Jaro similarity; 1 for two empty strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    matched = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(matched, (y for y, f in zip(b, free) if not f))) // 2
    return (m / len(a) + m / len(b) + (m - turned) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a common beginning of up to four characters, where it is above 0.7."""
    j = jaro(a, b)
    if j <= BOOST_FROM:
        return j
    n = 0
    while n < min(PREFIX_LENGTH, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + n * PREFIX_WEIGHT * (1 - j)


def _nullable(f):
    return lambda a, b: None if a is None or b is None else f(a, b)


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    one = _nullable(jaro_winkler)
    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler_column(a: Column, b: Column) -> Column:
    """Similarity of two columns compared in lower case; null where one is null."""
    return _jaro_winkler(F.lower(a), F.lower(b))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def casefold(c: Column) -> Column:
    """Full case folding (ß as ss), which the built-in lower doesn't do."""
    return _casefold(c)


def canonical_category(c: Column) -> Column:
    """One label for both names of artificial intelligence; other categories as they are."""
    return F.when(F.lower(c).isin(*AI_ALIASES), F.lit(AI_LABEL)).otherwise(c)


def canonical_categories(c: Column) -> Column:
    """A list of categories under canonical labels, the first of those that differ only in case."""
    named = F.transform(c, canonical_category)
    lower = F.transform(named, F.lower)
    return F.filter(named, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def company_name(filename: Column, text: Column, marker: str = "YC Startup Profile:") -> Column:
    """The name in the first line with the marker (after its last occurrence there), else the file's title."""
    from ..sources.loader import file_title

    line = F.regexp_extract(text, rf"(?m)^.*{marker}(.*)$", 1)
    has = F.coalesce(F.contains(text, F.lit(marker)), F.lit(False))
    return F.when(has, F.trim(line)).otherwise(file_title(filename))


def alternate_names(name: Column) -> Column:
    """Other names to look a company up by: with ``startup``, ``Inc``, ``Inc.``, and without a legal ending."""
    stripped = F.regexp_replace(name, r"(?i)\s+(Inc\.?|LLC|Ltd\.?|Corp\.?)$", "")
    return F.filter(F.array(F.concat(name, F.lit(" startup")), F.concat(name, F.lit(" Inc")), F.concat(name, F.lit(" Inc.")), stripped), lambda a: a != name)


def page_url(title: Column, base: str = "https://en.wikipedia.org/wiki/") -> Column:
    return F.concat(F.lit(base), F.translate(title, " ", "_"))


def client_ip(real: Column, forwarded: Column, peer: Column) -> Column:
    """The client's address: the first header that is filled, its first part; the port of an IPv4 address is cut."""
    first = F.trim(F.split_part(F.coalesce(F.nullif(F.trim(real), F.lit("")), F.nullif(F.trim(forwarded), F.lit("")), peer), F.lit(","), F.lit(1)))
    return F.when(first.rlike(r"^[\d.]+:\d+$"), F.split_part(first, F.lit(":"), F.lit(1))).otherwise(first)


def mentions_number(text: Column, number: Column) -> Column:
    """Whether a text has a number by itself, not as a part of a longer one."""
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])"), F.replace(number.cast("string"), F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d.])")))
