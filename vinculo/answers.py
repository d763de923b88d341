"""Answers from result rows: normal categories, a grounded listing, and a test whether a text contradicts the rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions.text import AI_ALIASES, AI_LABEL, CATEGORY_FIELDS, canonical_categories, canonical_category
from .plans import syntax as S
from .plans.lowering import MAX_RESULTS
from .plans.tokens import QueryError

# Fixed value: the answer to an empty result.
NO_RESULTS = "No results found for this query. The data may not contain enough information to answer this question."
# How a text says that there are no data.
NO_DATA = [
    r"^\s*the data (?:provided )?does not contain enough information",
    r"^\s*based on the (?:provided )?data,? there (?:is|are) insufficient",
    r"there (?:is|are) insufficient information to determine",
    r"^\s*no results (?:were )?found",
    r"cannot determine .+ from the (?:provided )?data",
]
UNTELLING = {"status", "stage"}


def normal_categories(rows: DataFrame) -> DataFrame:
    """The category columns of a result under canonical labels; lists lose elements that then differ only in case."""
    out = []
    for f in rows.schema.fields:
        c = rows[f"`{f.name}`"]
        if f.name.casefold() in CATEGORY_FIELDS:
            if isinstance(f.dataType, T.StringType):
                c = canonical_category(c)
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
                c = canonical_categories(c)
        out.append(c.alias(f.name))
    return rows.select(*out)


def normal_value(value, category: bool = False):
    """The same for plain values, through lists, tuples and dicts; a dict's key tells whether its value is a category."""
    if isinstance(value, str):
        return AI_LABEL if category and value.casefold() in AI_ALIASES else value
    if isinstance(value, dict):
        return {k: normal_value(v, str(k).casefold() in CATEGORY_FIELDS) for k, v in value.items()}
    if isinstance(value, tuple):
        return tuple(normal_value(v, category) for v in value)
    if isinstance(value, list):
        items = [normal_value(v, category) for v in value]
        if not category:
            return items
        first: dict = {}
        for i, v in enumerate(items):
            first.setdefault(v.casefold() if isinstance(v, str) else (i,), v)
        return list(first.values())
    return value


def empty(value) -> bool:
    """Null and empty texts, lists and maps say nothing; 0 and False do."""
    return value is None or (isinstance(value, (str, list, dict)) and not value)


def substantive(rows: list[dict]) -> bool:
    return any(not empty(v) for r in rows for v in r.values())


def no_data_claim(text: str) -> int | None:
    """Where a text first claims that there are no data."""
    return min((m.start() for p in NO_DATA if (m := re.search(p, text, re.I | re.S))), default=None)


def grounded(text: str, rows: list[dict], question: str = "") -> bool:
    """Whether a text has a value of the rows that the question doesn't have already."""
    low, asked = text.casefold(), question.casefold()
    for row in rows:
        for key, value in row.items():
            if str(key).casefold() in UNTELLING:
                continue
            for v in value if isinstance(value, list) else [value]:
                if isinstance(v, bool) or isinstance(v, str) and len(v.strip()) >= 3:
                    s = str(v).strip().casefold()
                    if s in low and s not in asked:
                        return True
                elif isinstance(v, (int, float)):
                    alone = rf"(?<![\d.]){re.escape(str(v))}(?![\d.])"
                    if re.search(alone, text) and not re.search(alone, question):
                        return True
    return False


def zero_count(rows: list[dict], query: str | None) -> bool:
    """Whether the rows are one aggregate that counted nothing."""
    if len(rows) != 1 or not query:
        return False
    try:
        counts = any(isinstance(x, S.Call) and x.name == "count" for x in S.parse(query).walk())
    except QueryError:
        counts = re.search(r"\bcount\s*\(", query, re.I) is not None
    told = [v for v in rows[0].values() if not empty(v)]
    return counts and bool(told) and all(v == 0 for v in told)


def listing(rows: list[dict]) -> str:
    """The rows as numbered lines, empty values left out, no more than MAX_RESULTS of them."""
    lines = [f"Found {len(rows)} matching record{'' if len(rows) == 1 else 's'}:"]
    for i, row in enumerate(rows[:MAX_RESULTS], 1):
        told = [(k.replace("_", " ").capitalize(), v) for k, v in row.items() if not empty(v)]
        lines.append(f"{i}. " + "; ".join(f"{k}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, v in told))
    if len(rows) > MAX_RESULTS:
        lines.append(f"Showing the first {MAX_RESULTS} of {len(rows)} records.")
    return "\n".join(lines)


def compose(question: str, rows: list[dict], query: str | None = None, write: Callable[[str, list[dict]], str] | None = None) -> str:
    """The answer to a question: by ``write`` if given and not contradicting the rows, else the listing."""
    if not rows:
        return NO_RESULTS
    if write is None:
        return listing(rows)
    text = write(question, rows[:MAX_RESULTS])
    claim = no_data_claim(text)
    contradicts = substantive(rows) and not zero_count(rows, query) and claim is not None and not grounded(text[:claim], rows, question)
    return listing(rows) if contradicts else text
