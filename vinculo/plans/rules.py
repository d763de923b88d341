"""Semantic rules: queries that run but answer another question than the one asked are refused.

The rules look at the syntax tree, so comments, literals and line breaks can't mislead them, and a variable's label is
known from its edges even where it isn't written. Each rule yields its complaints; ``check`` raises the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..catalog import EDGE_TYPES, NODE_COLUMNS
from ..functions.text import AI_ALIASES, AI_LABEL
from . import syntax as S
from .rewrites import expand_batches
from .tokens import QueryError, masked

# The fields that are compared without regard to case, and the categories that count as fintech.
FOLDED = {"Company": ("name",), "Founder": ("name",), "Investor": ("name",), "Industry": ("name",), "Technology": ("name",), "Location": ("city", "country")}
FINTECH = ("fintech", "finance", "payments")
# How a question shows what it asks for.
COUNTS_COMPANIES = r"\b(?:how many|number of|count|most|compare)\b.{0,80}\b(?:companies|startups)\b|\b(?:company|startup)\s+count\b"
COUNT_ALIAS = r"(?:company|startup)_count"
SHORT_BATCH = r"\b[WS]\d{2}\b"
ABOUT_AI = r"\bAI\b|\bArtificial\s+Intelligence\b"
NAMED_AI = r"\b(?:compan(?:y|ies)|startups?)\s+(?:(?:is|are)\s+)?(?:named|called)\s+['\"]?(?:AI|Artificial\s+Intelligence)\b"
B2B_SAAS = r"\bB2B\s+SaaS\b"
UPPER_SIZE = r"(?:fewer|less)\s+than\s+\d+\s+employees"
COMPANIES = r"\b(?:companies|startups)\b"
AGGREGATE = r"\b(?:how many|count|breakdown|average|avg|median|sum|total|percentage|percent|ratio)\b|\bnumber of(?:\s+\w+){0,3}\s+(?:companies|startups)\b"
TEXT_TESTS = ("=", "<>", "IN", "CONTAINS", "STARTS", "ENDS")
CATEGORIES = {"Industry": "OPERATES_IN", "Technology": "USES"}


class RuleError(ValueError):
    """A query that would answer another question."""


@dataclass
class Analysis:
    """What the rules need to know of a query."""

    question: str
    query: S.Query
    labels: dict[str, str] = field(default_factory=dict)
    written: dict[str, str] = field(default_factory=dict)
    links: set[tuple[str, str, str]] = field(default_factory=set)

    def __post_init__(self):
        for clause in self.query.clauses:
            if isinstance(clause, S.Match):
                for p in clause.patterns:
                    self._pattern(p)
            else:
                self._renames(clause)
        self.filters = [c.where for c in self.query.clauses if c.where is not None]

    def _pattern(self, p: S.Pattern) -> None:
        for n in p.nodes:
            if n.variable and n.label:
                self.written[n.variable] = self.labels[n.variable] = next((x for x in NODE_COLUMNS if x.casefold() == n.label.casefold()), n.label)
        for a, e, b in zip(p.nodes, p.edges, p.nodes[1:]):
            for kind in e.types:
                known = next((k for k in EDGE_TYPES if k.casefold() == kind.casefold()), None)
                if known is None:
                    continue
                start, end = (a, b) if e.direction != "<" else (b, a)
                for n, label in ((start, EDGE_TYPES[known][0]), (end, EDGE_TYPES[known][1])):
                    if n.variable:
                        self.labels.setdefault(n.variable, label)
                if start.variable and end.variable:
                    self.links.add((start.variable, known, end.variable))

    def _renames(self, p: S.Projection) -> None:
        for i in p.items:
            if isinstance(i.expr, S.Variable) and i.expr.name in self.labels:
                self.labels.setdefault(i.alias, self.labels[i.expr.name])

    # look-ups

    def variables(self, *labels: str) -> set[str]:
        return {v for v, x in self.labels.items() if x in labels}

    def maps(self) -> Iterator[tuple[S.NodePattern, str, S.Node]]:
        """The properties that patterns require, as (node, property, value)."""
        for x in self.query.walk():
            if isinstance(x, S.NodePattern):
                for key, value in x.properties.items():
                    yield x, key, value

    def tests(self) -> Iterator[S.Compare]:
        for where in self.filters:
            yield from (x for x in where.walk() if isinstance(x, S.Compare))

    def items(self) -> Iterator[S.Item]:
        for c in self.query.clauses:
            if isinstance(c, S.Projection):
                yield from c.items

    def calls(self, name: str) -> list[S.Call]:
        return [x for x in self.query.walk() if isinstance(x, S.Call) and x.name == name]

    def asks(self, pattern: str) -> bool:
        return re.search(pattern, self.question, re.I) is not None

    def returned_from(self, wanted) -> list[S.Item]:
        """The result items that come from an expression for which ``wanted`` holds, through WITH too."""
        names: set[str] = set()
        out = []
        for c in self.query.clauses:
            if not isinstance(c, S.Projection):
                continue
            hits = [i for i in c.items if wanted(i.expr) or isinstance(i.expr, S.Variable) and i.expr.name in names]
            names = {i.alias for i in hits}
            out = hits
        return out


def _is_property(x: S.Node, variable: str, name: str) -> bool:
    return isinstance(x, S.Property) and x.name == name and isinstance(x.owner, S.Variable) and x.owner.name == variable


def _folded(x: S.Node) -> S.Property | None:
    """The property inside a ``toLower``."""
    if isinstance(x, S.Call) and x.name == "tolower" and len(x.args) == 1 and isinstance(x.args[0], S.Property):
        return x.args[0]
    return None


def _texts(x: S.Node) -> list[str]:
    return [y.value for y in x.walk() if isinstance(y, S.Literal) and isinstance(y.value, str)]


# the rules, in the order in which they are checked


def case_insensitive_names(a: Analysis) -> Iterator[str]:
    """Names and places of labelled nodes aren't compared as written; what lower case is compared with is lower case."""
    for node, key, _ in a.maps():
        label = a.labels.get(node.variable or "") or next((x for x in FOLDED if x.casefold() == (node.label or "").casefold()), None)
        if key in FOLDED.get(label, ()):
            yield f"A property map compares {label}.{key} as it is written; test toLower of it against lower-case texts (case-insensitively)."
    for t in a.tests():
        if t.op not in TEXT_TESTS:
            continue
        for side, other in ((t.left, t.right), (t.right, t.left)):
            raw, low = side if isinstance(side, S.Property) else None, _folded(side)
            prop = raw or low
            if prop is None or not isinstance(prop.owner, S.Variable):
                continue
            label = a.written.get(prop.owner.name)
            if prop.name not in FOLDED.get(label, ()):
                continue
            if raw is not None and not isinstance(other, S.Property):
                yield f"{label}.{prop.name} is compared as it is written; wrap it as toLower({prop.owner.name}.{prop.name}) to compare case-insensitively."
            elif low is not None and t.op == "IN" and side is t.left and isinstance(other, S.ListOf):
                if not _texts(other) or any(v != v.lower() for v in _texts(other)):
                    yield f"The list beside toLower({prop.owner.name}.{prop.name}) holds texts that aren't in lower case."
            elif low is not None and isinstance(other, S.Literal) and isinstance(other.value, str) and other.value != other.value.lower():
                yield f"The text beside toLower({prop.owner.name}.{prop.name}) isn't in lower case, so nothing can equal it."


def distinct_company_counts(a: Analysis) -> Iterator[str]:
    """Companies are counted once however many paths lead to them."""
    companies = a.variables("Company")
    if not companies:
        return
    complaint = "A company on several paths would be counted several times; count DISTINCT {}."
    counts = a.calls("count")
    named = lambda c: isinstance(c, S.Variable) and c.name in companies
    good = False
    for c in counts:
        arg = c.args[0] if c.args else None
        if named(arg) and c.distinct:
            good = True
        elif named(arg) or not c.distinct and isinstance(arg, S.Property) and named(arg.owner):
            owner = arg if isinstance(arg, S.Variable) else arg.owner
            yield complaint.format(owner.name)
        elif isinstance(arg, S.Case):
            ends = [v for _, v in arg.whens] + [arg.otherwise]
            if any(named(v) for v in ends if v is not None):
                if not c.distinct:
                    yield "A count of companies under a condition needs DISTINCT before its CASE."
                good = True
    intent = a.asks(COUNTS_COMPANIES)
    intent = intent or any(re.fullmatch(COUNT_ALIAS, i.alias, re.I) for i in a.query.result.items)
    if intent and counts and (not good or any(c.star for c in counts)):
        yield complaint.format(min(companies))


def status_evidence(a: Analysis) -> Iterator[str]:
    """A list of companies chosen by status shows the status."""
    for v in sorted(a.variables("Company")):
        filtered = any(_is_property(x, v, "status") for w in a.filters for x in w.walk()) or any(n.variable == v and key == "status" for n, key, _ in a.maps())
        if not filtered or not a.returned_from(lambda e, v=v: _is_property(e, v, "name")):
            continue
        if not any(i.alias == "status" for i in a.returned_from(lambda e, v=v: _is_property(e, v, "status"))):
            yield "Companies are chosen by their status, but the result has no column status that shows it."


def full_batch_names(a: Analysis) -> Iterator[str]:
    """Batches are filtered by their full names."""
    for m in re.finditer(SHORT_BATCH, a.question, re.I):
        short, full = m[0], expand_batches(m[0])
        complaint = f'Batches are kept under their full names: "{short}" is "{full}".'
        texts = _texts(a.query)
        filtered = any(full in _texts(t) and any(isinstance(x, S.Property) and x.name in ("name", "yc_batch") or isinstance(x, S.Variable) for x in t.walk()) for t in a.tests() if t.op in ("=", "IN"))
        filtered = filtered or any(key in ("name", "yc_batch") and full in _texts(value) for _, key, value in a.maps())
        if any(x.casefold() == short.casefold() for x in texts) or not filtered:
            yield complaint


def both_ai_names(a: Analysis) -> Iterator[str]:
    """The two names of artificial intelligence are one category, unless they are part of a company's name."""
    if not a.asks(ABOUT_AI):
        return
    if a.asks(NAMED_AI) and len(re.findall(ABOUT_AI, a.question, re.I)) == 1:
        return
    names = [v for n, key, value in a.maps() if key == "name" and a.labels.get(n.variable or "") == "Company" for v in _texts(value)]
    for t in a.tests():
        if t.op in ("=", "CONTAINS") and any(_is_property(x, v, "name") for x in t.walk() for v in a.variables("Company")):
            names += _texts(t)
    rest = a.question
    for n in names:
        if n.casefold() not in AI_ALIASES and re.search(ABOUT_AI, n, re.I):
            rest = re.sub(re.escape(n), "", rest, flags=re.I)
    if rest != a.question and not re.search(ABOUT_AI, rest, re.I):
        return
    for t in a.tests():
        low = _folded(t.left)
        if t.op == "IN" and low is not None and low.name == "name" and a.labels.get(getattr(low.owner, "name", "")) in CATEGORIES and set(AI_ALIASES) <= {x.casefold() for x in _texts(t.right)}:
            return
    yield 'Artificial intelligence has two names; test the category for both of them, "ai" and "artificial intelligence", by IN.'


def canonical_categories(a: Analysis) -> Iterator[str]:
    """Categories are grouped under one label for both names of artificial intelligence."""
    if not a.calls("count"):
        return
    complaint = f"Categories are grouped as written, so the two names of {AI_LABEL} would be two groups; map both to that label first."
    categories = a.variables(*CATEGORIES)
    for i in a.items():
        cases = [x for x in i.expr.walk() if isinstance(x, S.Case)]
        inside = {id(y) for c in cases for y in c.walk()}
        for x in i.expr.walk():
            if isinstance(x, S.Property) and x.name == "name" and isinstance(x.owner, S.Variable) and x.owner.name in categories and id(x) not in inside:
                yield complaint
        for c in cases:
            about = any(isinstance(x, S.Property) and x.name == "name" and getattr(x.owner, "name", "") in categories for x in c.walk())
            to_label = any(isinstance(v, S.Literal) and v.value == AI_LABEL for _, v in c.whens)
            if about and not (set(AI_ALIASES) <= {t.casefold() for t in _texts(c)} and to_label) and not any(isinstance(v, S.Variable) for _, v in c.whens):
                yield complaint


def both_of_b2b_saas(a: Analysis) -> Iterator[str]:
    """Two categories asked for together are both required."""
    if not a.asks(B2B_SAAS):
        return
    texts = " ".join(t.casefold() for t in _texts(a.query))
    if "b2b" not in texts or "saas" not in texts:
        yield "Of the categories B2B and SaaS at least one is never tested."
        return
    names = lambda x: {t.casefold() for t in _texts(x)} & {"b2b", "saas"}
    for w in a.filters:
        for x in w.walk():
            if isinstance(x, S.Logic) and x.op == "OR":
                sides = [names(p) for p in x.parts]
                if {"b2b"} in sides and {"saas"} in sides:
                    member = any(isinstance(p, S.Compare) and p.op == "IN" and isinstance(p.left, S.Literal) for p in x.parts)
                    yield "B2B and SaaS are joined by OR on a list of categories; both are asked for." if member else "B2B and SaaS are joined by OR; both are asked for."
            if isinstance(x, S.Compare) and x.op == "IN" and isinstance(x.right, S.ListOf) and names(x.right) == {"b2b", "saas"}:
                yield "IN takes B2B or SaaS; both are asked for."


def known_team_sizes(a: Analysis) -> Iterator[str]:
    """An upper bound on the team size leaves out unknown sizes, which are 0."""
    if not a.asks(UPPER_SIZE):
        return
    size = lambda x: isinstance(x, S.Property) and x.name == "team_size" or isinstance(x, S.Variable) and x.name == "team_size"
    tests = list(a.tests())
    upper = any(size(t.left) and t.op in ("<", "<=") or size(t.right) and t.op in (">", ">=") for t in tests)
    zero = lambda x: isinstance(x, S.Literal) and x.value == 0
    known = any(size(t.left) and t.op == ">" and zero(t.right) or size(t.right) and t.op == "<" and zero(t.left) for t in tests)
    if upper and not known:
        yield "A team size of 0 is an unknown one; demand that it is above 0 as well."


def fintech_lists(a: Analysis) -> Iterator[str]:
    """A list of fintech companies takes all names of that industry and shows which one matched."""
    aggregate = a.asks(AGGREGATE)
    if not a.asks(COMPANIES) or aggregate or not a.asks(r"\bfintech\b"):
        return
    filters = {t.casefold() for w in a.filters for t in _texts(w)}
    if not all(any(n in f for f in filters) for n in FINTECH):
        yield "Fintech goes by three names here: fintech, finance and payments; test for all."
        return
    companies = {i.expr.owner.name for i in a.query.result.items if i.alias == "company" and isinstance(i.expr, S.Property) and i.expr.name == "name" and isinstance(i.expr.owner, S.Variable)}
    linked = lambda kind: {end for start, k, end in a.links if k == kind and start in companies}
    matched = {v for v in linked("OPERATES_IN") for t in a.tests() if t.op == "IN" and _folded(t.left) and _is_property(_folded(t.left), v, "name") and set(FINTECH) <= set(_texts(t.right))}
    if not matched:
        yield "The test for the three fintech names isn't on an industry of the company that is listed."
        return
    shows = lambda vs, alias: any(i.alias == alias and any(_is_property(i.expr, v, "name") for v in vs) for i in a.query.result.items)
    if not shows(matched, "industry"):
        yield "The result has no column industry with the industry that fitted."
    if a.asks(r"\bpython\b"):
        used = {v for v in linked("USES") for t in a.tests() if t.op == "=" and _folded(t.left) and _is_property(_folded(t.left), v, "name") and _texts(t.right) == ["python"]}
        if not used:
            yield "Nothing tests that the listed company uses python."
        elif not shows(used, "technology"):
            yield "The result has no column technology with the technology that fitted."


RULES = (case_insensitive_names, distinct_company_counts, status_evidence, full_batch_names, both_ai_names, canonical_categories, both_of_b2b_saas, known_team_sizes, fintech_lists)


def complaints(question: str, text: str) -> list[tuple[str, str]]:
    """(rule, complaint) of all rules that a query breaks; a text that can't be read breaks ``readable``."""
    if re.search(r"\bUNION\b", masked(text), re.I):
        return [("no_union", "UNION isn't supported; ask in one query.")]
    try:
        analysis = Analysis(question, S.parse(text))
    except QueryError as e:
        return [("readable", str(e))]
    return [(rule.__name__, c) for rule in RULES for c in dict.fromkeys(rule(analysis))]


def check(question: str, text: str) -> None:
    """Raise the first complaint."""
    for rule, complaint in complaints(question, text):
        raise QueryError(complaint) if rule == "readable" else RuleError(complaint)
