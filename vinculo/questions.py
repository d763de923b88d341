"""Questions in words: a classifier and templates for the catalogue of questions; others fail loudly.

A generator of query texts (a callable of question, last error and last text) can take the templates' place; its
queries are capped and checked like any other, and it is asked again with the error, three times at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import normal_categories
from .catalog import Graph
from .functions.text import AI_ALIASES, AI_LABEL
from .plans.lowering import MAX_RESULTS, answer
from .plans.rewrites import cap_results, expand_batches, strip_fences
from .plans.rules import FINTECH, check

RETRIES = 3
_q = lambda words: "[" + ", ".join(f'"{w}"' for w in words) + "]"
_label = lambda v: f'CASE WHEN toLower({v}.name) IN {_q(AI_ALIASES)} THEN "{AI_LABEL}" ELSE {v}.name END'


@dataclass(frozen=True)
class Template:
    """A form of questions, as a regular expression with named parts, and its query; parts are put in as lower case."""

    name: str
    pattern: str
    query: str


# Steps of paths, with the variables that all templates use for their ends.
STEPS = {
    "person": "(person:Founder)-[:FOUNDED]->(firm:Company)", "backer": "(backer:Investor)-[:INVESTED_IN]->(firm:Company)", "place": "(firm:Company)-[:HEADQUARTERED_IN]->(place:Location)",
    "sector": "(firm:Company)-[:OPERATES_IN]->(sector:Industry)", "tool": "(firm:Company)-[:USES]->(tool:Technology)", "cohort": "(firm:Company)-[:PART_OF]->(cohort:Batch)",
    "deal": "(firm:Company)-[:RAISED]->(deal:FundingEvent)", "buyer": "(firm:Company)-[:ACQUIRED_BY]->(buyer:Company)", "firm": "(firm:Company)",
}
_ACCELERATOR = 'toLower(backer.name) <> "y combinator"'
_COUNT = "count(DISTINCT firm) AS n_companies"


def _plan(steps: str, give: str, where: str = "", order: str = "", limit: str = "", then: str = "") -> str:
    """A query: the paths of some steps, a filter, an optional second stage, the result and its order."""
    paths = " ".join(f"MATCH {STEPS[step]}" for step in steps.split())
    return paths + (f" WHERE {where}" if where else "") + (f" {then}" if then else "") + f" RETURN {give}" + (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")


def _most(step: str, shown: str, alias: str, where: str = "", limit: str = "20") -> str:
    return _plan(step, f"{shown} AS {alias}, {_COUNT}", where, f"n_companies DESC, {alias}", limit)


#: Templates in the order in which they are tried.
TEMPLATES = [
    Template("founders_of_fintechs", r"founders from (?P<country>[\w ]+?) built fintech", _plan("person place sector", "firm.name AS company, sector.name AS industry, person.name AS founder, firm.yc_batch AS batch", f'toLower(sector.name) IN {_q(FINTECH)} AND toLower(place.country) = "{{country}}"', "company, founder, industry")),
    Template("founders_of", r"^(?:who founded|who are the founders of|founders of) (?P<names>.+?)\?*$", _plan("person", "firm.name AS company, person.name AS founder, firm.yc_batch AS batch", "toLower(firm.name) IN {names}", "company, founder")),
    Template("cities_of_ai", r"compare (?:ai|artificial intelligence) (?:companies|startups) in (?P<names>(?!.*\b(?:winter|summer) 20).+ and .+?)\.?\?*$", _plan("sector place", f"place.city AS city, {_COUNT}, collect(DISTINCT firm.name)[0..10] AS examples", f"toLower(place.city) IN {{names}} AND toLower(sector.name) IN {_q(AI_ALIASES)}", "n_companies DESC, city")),
    Template("python_fintech", r"python and operate in fintech|python in fintech|python and fintech", _plan("sector tool", "DISTINCT firm.name AS company, sector.name AS industry, tool.name AS technology, firm.yc_batch AS batch", f'toLower(sector.name) IN {_q(FINTECH)} AND toLower(tool.name) = "python"', "company, industry")),
    Template("dead_by_industry", r"industries have the most (?:failed|dead)", _most("sector", _label("sector"), "industry", 'firm.status = "Dead"')),
    Template("active_by_industry", r"industries (?:have|with) the most active", _most("sector", _label("sector"), "industry", 'firm.status = "Active"')),
    Template("top_industries", r"(?:top (?P<n>\d+) )?industries (?:are )?(?:most represented|by (?:number|count) of|across)", _most("sector", _label("sector"), "industry", limit="{n|20}")),
    Template("technologies_of_industry", r"technologies (?:are )?(?:most )?(?:commonly |often |widely )?used by (?!yc\b)(?P<sector>[\w-]+(?: [\w-]+)?) (?:companies|startups)", _most("sector tool", _label("tool"), "technology", 'toLower(sector.name) CONTAINS "{sector}"')),
    Template("top_technologies", r"technologies (?:are )?most (?:commonly )?used|most used technologies", _most("tool", _label("tool"), "technology")),
    Template("technologies_of", r"technologies (?:are used by|does|used by) (?P<name>.+?)(?: use)?\?*$", _plan("tool", "tool.name AS technology, firm.name AS company", 'toLower(firm.name) = "{name}"', "technology")),
    Template("portfolios", r"investors (?:have|with) the most (?:yc )?(?:portfolio )?companies", _plan("backer", f"backer.name AS investor, {_COUNT}, collect(DISTINCT firm.name)[0..5] AS examples", _ACCELERATOR, "n_companies DESC, investor", "20")),
    Template("shared_investors", r"backed both (?P<a>.+?) and (?P<b>.+?)\?*$", f'MATCH (firm:Company)<-[:INVESTED_IN]-(backer:Investor)-[:INVESTED_IN]->(other:Company) WHERE {_ACCELERATOR} AND toLower(firm.name) = "{{a}}" AND toLower(other.name) = "{{b}}" RETURN DISTINCT backer.name AS investor ORDER BY investor'),
    Template("investors_of", r"(?:who invested in|investors of|who are the investors of) (?P<name>.+?)\?*$", _plan("backer", "firm.name AS company, backer.name AS investor", f'{_ACCELERATOR} AND toLower(firm.name) = "{{name}}"', "investor")),
    Template("status_counts", r"active vs\.? dead|by status|how many .*(?:active|dead|acquired).* vs", _most("firm", "firm.status", "status", limit="")),
    Template("stage_counts", r"by stage|companies are (?:at|in) each stage", _most("firm", "firm.stage", "stage", limit="")),
    Template("failure_patterns", r"patterns among failed", _plan("firm", f"{_label('sector')} AS industry, place.country AS country, cohort.name AS cohort, {_COUNT}", 'firm.status = "Dead"', "n_companies DESC, industry, country, cohort", "50", "OPTIONAL MATCH (firm)-[:PART_OF]->(cohort:Batch) OPTIONAL MATCH (firm)-[:OPERATES_IN]->(sector:Industry) OPTIONAL MATCH (firm)-[:HEADQUARTERED_IN]->(place:Location)")),
    Template("acquisitions", r"acquired(?: and)? by whom|were acquired", _plan("buyer", "firm.name AS company, buyer.name AS buyer, firm.yc_batch AS batch", order="company, buyer")),
    Template("repeat_founders", r"connected founders|founders .*\bmore than one\b", _plan("person", "person.name AS founder, n_companies, names", order="n_companies DESC, founder", limit="20", then=f"WITH person, {_COUNT}, collect(DISTINCT firm.name) AS names WHERE n_companies > 1")),
    Template("most_rounds", r"most funding rounds", _plan("deal", "firm.name AS company, n_rounds", order="n_rounds DESC, company", limit="20", then="WITH firm, count(deal) AS n_rounds WHERE n_rounds > 2")),
    Template("raised_round", r"raised (?P<round>series [a-z]|seed|pre-seed)", _plan("deal", "firm.name AS company, deal.amount AS amount, deal.year AS year, firm.yc_batch AS batch", 'toLower(deal.round) CONTAINS "{round}"', "year DESC, company, amount")),
    Template("funding_history", r"(?:what is )?(?P<name>.+?)['’]s funding history", _plan("deal", "firm.name AS company, deal.year AS year, deal.round AS round, deal.amount AS amount", 'toLower(firm.name) CONTAINS "{name}"', "year, company, round")),
    Template("count_ai", r"how many (?:yc )?(?:companies|startups) use (?:ai|artificial intelligence)", _plan("tool", _COUNT, f"toLower(tool.name) IN {_q(AI_ALIASES)}")),
    Template("cohorts_of_industry", r"batches (?:have|produced|with) the most (?P<name>[\w -]+?) (?:companies|startups)", _most("sector cohort", "cohort.name", "cohort", 'toLower(sector.name) CONTAINS "{name}"')),
    Template("survival", r"survival rate", _plan("sector", "industry, survivors * 1.0 / judged AS survival_rate, judged", order="survival_rate DESC, industry", then=f'WITH {_label("sector")} AS industry, count(DISTINCT CASE WHEN firm.status IN ["Active", "Public", "Acquired"] THEN firm END) AS survivors, count(DISTINCT CASE WHEN firm.status IS NOT NULL THEN firm END) AS judged WHERE judged > 0')),
]


class UnknownQuestion(ValueError):
    """A question that neither a template nor its facets answer."""


# The words of a question that choose companies by status, and words before "companies" that are no category.
STATUS_WORDS = {"active": ["Active"], "dead": ["Dead"], "failed": ["Dead"], "inactive": ["Dead"], "acquired": ["Acquired"], "public": ["Public"]}
NO_CATEGORY = {"which", "what", "the", "all", "yc", "of", "many", "some", "list", "most", "are", "name", "show", "these", "other", "any", "and", "or", "from", "for", "compare", "have", "has", "in", "to", "by", "with"}


def facets_query(question: str) -> str:
    """A query for companies chosen by what a question names: category, place, batch, status, size, funding, rival.

    It lists them with the evidence for each choice, counts them if asked how many, and counts by batch or city where
    several are compared. A question that names none of these isn't answered.
    """
    q = expand_batches(question).strip().rstrip("?.! ")
    low = q.lower()
    matches, wheres, shown = [], [], ["c.name AS company"]
    quoted = lambda t: '"' + t.strip().lower().replace("\\", "").replace('"', "") + '"'

    rival = re.search(r"compet\w*\s+with\s+(?P<name>.+)$", q, re.I)
    if rival:
        matches.append("MATCH (c)-[:COMPETES_WITH]->(rival:Company)")
        wheres.append(f"toLower(rival.name) = {quoted(rival['name'])}")
        shown.append("rival.name AS competitor")
        low = low[: rival.start()]
    investors = re.search(r"\binvestors\b", low)
    using = re.search(r"\b(?:use|uses|using)\s+(?P<name>[\w.+#-]+(?: intelligence)?)", low)
    ai = re.search(r"\bai\b|\bartificial intelligence\b", low)
    words = re.findall(r"\b([a-z][\w-]+)\s+(?:companies|startups)\b", q) + re.findall(r"\b(?:investors|invest|operate|operating) in ([a-z][\w-]+)", q)
    made = re.search(r"\b(?:build|builds|building|make|makes|making|sell|selling|develop|developing)\s+(?P<name>[a-z][\w -]*)$", q)
    words += [made["name"]] if made else []
    category = next((w for w in words if w not in NO_CATEGORY and w not in STATUS_WORDS and w not in ("ai", "intelligence", "b2b", "saas") and not w.isdigit()), None)
    if using and not ai:
        matches.append("MATCH (c)-[:USES]->(t:Technology)")
        wheres.append(f"toLower(t.name) = {quoted(using['name'])}")
        shown.append("t.name AS technology")
    if ai:
        v, label, kind, alias = ("t", "Technology", "USES", "technology") if using else ("ai", "Industry", "OPERATES_IN", "industry")
        matches.append(f"MATCH (c)-[:{kind}]->({v}:{label})")
        wheres.append(f"toLower({v}.name) IN {_q(AI_ALIASES)}")
        shown.append(f"{_label(v)} AS {alias}")
    if category:
        matches.append("MATCH (c)-[:OPERATES_IN]->(ind:Industry)")
        stem = category.replace("-", " ").removesuffix("s")
        wheres.append(f"toLower(ind.name) IN {_q(FINTECH)}" if category == "fintech" else f"toLower(ind.name) CONTAINS {quoted(stem)}")
        shown.append("ind.name AS " + ("category" if ai and not using else "industry"))
    if re.search(r"\bb2b\b", low) and re.search(r"\bsaas\b", low):
        for word in ("b2b", "saas"):
            matches.append(f"MATCH (c)-[:OPERATES_IN]->({word}:Industry)")
            wheres.append(f'toLower({word}.name) CONTAINS "{word}"')
    batches = re.findall(r"\b(?:Winter|Summer) 20\d\d\b", q)
    if batches:
        wheres.append(f"c.yc_batch IN {_q(dict.fromkeys(batches))}")
        shown.append("c.yc_batch AS batch")
    place = re.search(r"\b(?:headquartered in|based in|from|in)\s+(?P<names>(?:[A-Z][\w.]*)(?:\s+[A-Z][\w.]*)*(?:\s+(?:and|vs\.?|or)\s+(?:[A-Z][\w.]*)(?:\s+[A-Z][\w.]*)*)?)", re.sub(r"\b(?:Winter|Summer) 20\d\d\b", "", q))
    place = place or re.search(r"(?<!^)\b(?P<names>(?!YC|AI|B2B|SaaS)[A-Z][a-z]\w*(?: [A-Z]\w*)*) (?:companies|startups)", q)
    places = [p for p in re.split(r"\s+(?:and|vs\.?|or)\s+", place["names"]) if p.lower() not in AI_ALIASES] if place else []
    if places:
        names = _q([p.lower() for p in places])
        matches.append("MATCH (c)-[:HEADQUARTERED_IN]->(l:Location)")
        wheres.append(f"(toLower(l.city) IN {names} OR toLower(l.country) IN {names})")
        shown += ["l.city AS city", "l.country AS country"]
    statuses = sorted({x for w, xs in STATUS_WORDS.items() if re.search(rf"\b{w}\b", low) for x in xs})
    if statuses:
        wheres.append(f"c.status IN {_q(statuses)}")
        shown.append("c.status AS status")
    size = re.search(r"\b(?P<how>fewer|less|more) than (?P<n>\d+) (?:employees|people|staff)", low)
    if size:
        wheres.append(f"c.team_size > {size['n']}" if size["how"] == "more" else f"c.team_size > 0 AND c.team_size < {size['n']}")
        shown.append("c.team_size AS team_size")
    if re.search(r"\braised\b", low):
        matches.append("MATCH (c)-[:RAISED]->(fe:FundingEvent)")
        wheres.append("fe.round IS NOT NULL")
    if not wheres:
        raise UnknownQuestion(f"nothing in {question!r} tells which companies are meant")
    where = f"MATCH (c:Company) {' '.join(matches)} WHERE {' AND '.join(wheres)} "
    if investors:
        return f"MATCH (c:Company)<-[:INVESTED_IN]-(i:Investor) {' '.join(matches)} WHERE {' AND '.join(wheres)} AND toLower(i.name) <> \"y combinator\" RETURN DISTINCT i.name AS investor ORDER BY investor"
    if len(batches) > 1 and re.search(r"\bcompare\b|\bvs\b", low):
        return where + "RETURN c.yc_batch AS batch, count(DISTINCT c) AS n_companies ORDER BY n_companies DESC, batch"
    if len(places) > 1:
        return where + "RETURN l.city AS city, count(DISTINCT c) AS n_companies ORDER BY n_companies DESC, city"
    if re.search(r"\bhow many\b|\bnumber of\b", low):
        return where + "RETURN count(DISTINCT c) AS n_companies"
    return where + f"RETURN DISTINCT {', '.join(shown)} ORDER BY company"


def query_for(question: str) -> tuple[str, str]:
    """(template or ``facets``, query text) for a question."""
    text = expand_batches(question).strip()
    # founders asked for in several sentences, of names written with capitals
    asked = re.findall(r"\b(?:founded|founders of) ((?:[A-Z][\w.&-]*\w)(?:(?: |, | and |, and )[A-Z][\w.&-]*\w)*)", text)
    if asked and re.search(r"\bwho\b", text, re.I):
        founders = next(t for t in TEMPLATES if t.name == "founders_of")
        return founders.name, _fill(founders.query, {"names": " and ".join(asked)})
    for t in TEMPLATES:
        m = re.search(t.pattern, text, re.I)
        if m:
            parts = {k: v for k, v in m.groupdict().items() if v}
            return t.name, _fill(t.query, parts)
    return "facets", facets_query(question)


def _fill(query: str, parts: dict[str, str]) -> str:
    clean = {k: v.strip().lower().replace("\\", "").replace('"', "") for k, v in parts.items()}
    if "sector" in clean:
        clean["sector"] = clean["sector"].replace("-", " ").removesuffix("s")
    if "names" in clean:
        names = [n.strip() for n in re.split(r",|\band\b", clean["names"]) if n.strip()]
        clean["names"] = _q(names)
        query = query.replace("IN {names}", "= " + _q(names)[1:-1]) if len(names) == 1 else query
    return re.sub(r"\{(\w+)(?:\|(\w+))?\}", lambda m: clean.get(m[1], m[2] or ""), query)


def classify(question: str, graph: Graph) -> str:
    """``local`` if the question names a company, founder or investor of the graph, else ``global``.

    The names are searched in the question by a filter on each table, not collected.
    """
    asked = F.lit(f" {re.sub(r'[^\w]+', ' ', question.lower())} ")
    for label in ("Company", "Founder", "Investor"):
        if label in graph.nodes:
            name = F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_]+", " ")
            if not graph.node(label).where((F.length("name") > 2) & F.contains(asked, F.concat(F.lit(" "), F.trim(name), F.lit(" ")))).isEmpty():
                return "local"
    return "global"


def ask(graph: Graph, question: str, generate: Callable[[str, str | None, str | None], str] | None = None) -> tuple[DataFrame, str]:
    """(result, query text) for a question, capped and with normal categories."""
    error = previous = None
    for attempt in range(RETRIES):
        try:
            previous = strip_fences(generate(expand_batches(question), error, previous)) if generate else query_for(question)[1]
            text = cap_results(previous)
            check(question, text)
            return normal_categories(answer(graph, text, cap=MAX_RESULTS)), text
        except ValueError as e:
            error = str(e)
            if generate is None or attempt == RETRIES - 1:
                raise
    raise AssertionError
