"""Each rule refuses what it is for and lets through what it isn't for; questions, names and queries are invented."""

import pytest

from vinculo.plans.rules import complaints

FIRMS = "MATCH (x:Company) "
SECTORS = "MATCH (x:Company)-[:OPERATES_IN]->(s:Industry) "
TOOLS = "MATCH (x:Company)-[:USES]->(k:Technology) "
BOTH_NAMES = '["ai", "artificial intelligence"]'
CANONICAL = f'CASE WHEN toLower(s.name) IN {BOTH_NAMES} THEN "Artificial Intelligence" ELSE s.name END'
FINANCIAL = 'toLower(s.name) IN ["fintech", "finance", "payments"]'

REFUSED = {
    "case_insensitive_names": [
        ("Where does Kestrel Foods sit?", FIRMS + 'WHERE x.name = "Kestrel Foods" RETURN x.name AS company'),
        ("Where does Kestrel Foods sit?", FIRMS + 'WHERE toLower(x.name) = "Kestrel Foods" RETURN x.name AS company'),
        ("Where do they sit?", 'MATCH (x:Company {name: "Kestrel Foods"}) RETURN x.name AS company'),
        ("Who backs them?", 'MATCH (b:Investor)-[:INVESTED_IN]->(x:Company) WHERE toLower(b.name) IN ["moss capital", "Fern Angels"] RETURN x.name AS company'),
        ("Who sits in Oslo?", 'MATCH (x:Company)-[:HEADQUARTERED_IN]->(p:Location) WHERE p.city ENDS WITH "Oslo" RETURN x.name AS company'),
    ],
    "distinct_company_counts": [
        ("How many companies use Rust?", TOOLS + 'WHERE toLower(k.name) = "rust" RETURN count(x) AS amount'),
        ("How many companies are in the graph?", FIRMS + "RETURN count(*) AS amount"),
        ("Which cities host the most startups?", "MATCH (x:Company)-[:HEADQUARTERED_IN]->(p:Location) RETURN p.city AS city, count(x.name) AS amount"),
        ("How many companies grew?", FIRMS + 'RETURN count(CASE WHEN x.stage = "Growth" THEN x END) AS amount'),
    ],
    "status_evidence": [
        ("Which firms are public?", FIRMS + 'WHERE x.status = "Public" RETURN x.name AS company'),
        ("Which firms are public?", 'MATCH (x:Company {status: "Public"}) RETURN x.name AS company, x.stage AS stage'),
    ],
    "full_batch_names": [
        ("Who was in S18?", FIRMS + 'WHERE x.yc_batch = "S18" RETURN x.name AS company'),
        ("Who was in S18 and W19?", FIRMS + 'WHERE x.yc_batch = "Summer 2018" RETURN x.name AS company'),
    ],
    "both_ai_names": [
        ("List AI companies.", SECTORS + 'WHERE toLower(s.name) = "artificial intelligence" RETURN x.name AS company'),
        ("List AI companies.", SECTORS + 'WHERE s.name CONTAINS "AI" RETURN x.name AS company'),
    ],
    "canonical_categories": [
        ("Which industries are crowded?", SECTORS + "RETURN s.name AS industry, count(DISTINCT x) AS amount"),
        ("Which industries are crowded?", SECTORS + "WITH toLower(s.name) AS kind, count(DISTINCT x) AS amount RETURN kind, amount"),
    ],
    "both_of_b2b_saas": [
        ("Name B2B SaaS firms.", SECTORS + 'WHERE toLower(s.name) IN ["saas", "b2b"] RETURN x.name AS company'),
        ("Name B2B SaaS firms.", SECTORS + 'WHERE toLower(s.name) = "saas" OR toLower(s.name) = "b2b" RETURN x.name AS company'),
        ("Name B2B SaaS firms.", SECTORS + 'WHERE toLower(s.name) = "saas" RETURN x.name AS company'),
    ],
    "known_team_sizes": [("Which companies have fewer than 12 employees?", FIRMS + "WHERE x.team_size < 12 RETURN x.name AS company, x.team_size AS team_size")],
    "fintech_lists": [
        ("Which fintech companies exist?", SECTORS + 'WHERE toLower(s.name) = "fintech" RETURN x.name AS company, s.name AS industry'),
        ("Which fintech companies exist?", SECTORS + f"WHERE {FINANCIAL} RETURN x.name AS company"),
        ("Which fintech companies use Python?", TOOLS + f"MATCH (x)-[:OPERATES_IN]->(s:Industry) WHERE {FINANCIAL} RETURN x.name AS company, s.name AS industry"),
    ],
    "no_union": [("Which?", "MATCH (x:Company) RETURN x.name AS name UNION MATCH (b:Investor) RETURN b.name AS name")],
    "readable": [("Which?", "MATCH (x:Company RETURN x")],
}

ACCEPTED = [
    ("Where does Kestrel Foods sit?", FIRMS + 'WHERE toLower(x.name) = "kestrel foods" RETURN x.name AS company'),
    ("How many companies use Rust?", TOOLS + 'WHERE toLower(k.name) = "rust" RETURN count(DISTINCT x) AS amount'),
    ("How many rounds were there?", "MATCH (x:Company)-[:RAISED]->(r:FundingEvent) RETURN count(r) AS rounds"),
    ("Which firms are public?", FIRMS + 'WHERE x.status = "Public" RETURN x.name AS company, x.status AS status'),
    ("How many companies are public?", FIRMS + 'WHERE x.status = "Public" RETURN count(DISTINCT x) AS amount'),
    ("Who was in S18 and W19?", FIRMS + 'WHERE x.yc_batch IN ["Summer 2018", "Winter 2019"] RETURN x.name AS company'),
    ("List AI companies.", SECTORS + f"WHERE toLower(s.name) IN {BOTH_NAMES} RETURN x.name AS company"),
    ("Who founded Fern AI?", 'MATCH (p:Founder)-[:FOUNDED]->(x:Company) WHERE toLower(x.name) = "fern ai" RETURN p.name AS founder'),
    ("Which industries are crowded?", SECTORS + f"RETURN {CANONICAL} AS industry, count(DISTINCT x) AS amount"),
    ("Name B2B SaaS firms.", 'MATCH (x:Company)-[:OPERATES_IN]->(s:Industry) MATCH (x)-[:OPERATES_IN]->(t:Industry) WHERE toLower(s.name) = "b2b" AND toLower(t.name) = "saas" RETURN x.name AS company'),
    ("Which companies have fewer than 12 employees?", FIRMS + "WHERE x.team_size > 0 AND x.team_size < 12 RETURN x.name AS company"),
    ("Which fintech companies exist?", SECTORS + f"WHERE {FINANCIAL} RETURN x.name AS company, s.name AS industry"),
    ("Which fintech companies use Python?", TOOLS + f'MATCH (x)-[:OPERATES_IN]->(s:Industry) WHERE toLower(k.name) = "python" AND {FINANCIAL} RETURN x.name AS company, k.name AS technology, s.name AS industry'),
]


@pytest.mark.parametrize("rule, case", [(rule, case) for rule, cases in REFUSED.items() for case in cases])
def test_refused(rule, case):
    assert rule in {r for r, _ in complaints(*case)}


@pytest.mark.parametrize("case", ACCEPTED)
def test_accepted(case):
    assert complaints(*case) == []
