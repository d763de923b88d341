import pytest
from pyspark.sql import functions as F

from tests.graphs import small_graph
from vinculo import answers as A
from vinculo import questions as Q
from vinculo import service
from vinculo.plans.rules import complaints
from vinculo.sources import querylog


@pytest.fixture(scope="module")
def graph(spark):
    return small_graph(spark)


ROWS = [{"company": "Stripe", "round": "Series A", "year": 2011, "status": "Active"}]


def test_values_and_lists():
    assert A.normal_value({"technology": "AI", "technologies": ["ai", "Go", "GO"], "company": "AI", "nested": [{"industry": "artificial intelligence"}]}) == {
        "technology": "Artificial Intelligence", "technologies": ["Artificial Intelligence", "Go"], "company": "AI", "nested": [{"industry": "Artificial Intelligence"}],
    }


def test_contradictions_are_replaced():
    deny = lambda q, r: "The data does not contain enough information."
    assert A.compose("Which?", ROWS, write=deny).startswith("Found 1 matching record:\n1. Company: Stripe; Round: Series A; Year: 2011")
    partial = "Stripe raised Series A. There is insufficient information to determine the amount."
    assert A.compose("Which?", ROWS, write=lambda q, r: partial) == partial
    echo = "About Stripe, there is insufficient information to determine anything."
    assert A.compose("What about Stripe?", ROWS, write=lambda q, r: echo) != echo
    assert A.compose("Which?", [], write=deny) == A.NO_RESULTS
    zero = "No results were found."
    assert A.compose("How many?", [{"n": 0}], "MATCH (c:Company) RETURN count(DISTINCT c) AS n", lambda q, r: zero) == zero
    assert A.compose("How many?", [{"n": 0, "total": None}], "MATCH (c:Company) RETURN c.x AS n", lambda q, r: zero) != zero
    status = "The status is Active, but there is insufficient information to determine more."
    assert A.compose("Which?", ROWS, write=lambda q, r: status) != status


def test_numbers_stand_alone():
    assert A.grounded("In 2011 it was", [{"y": 2011}]) and not A.grounded("In 20112", [{"y": 2011}]) and not A.grounded("2011", [{"y": 2011}], "in 2011?")
    assert A.grounded("it is true", [{"x": True}]) and not A.grounded("no", [{"x": "no"}])


def test_long_listings_are_cut():
    text = A.listing([{"company": f"c{i}", "tags": ["a", "b"], "none": None, "zero": 0} for i in range(55)])
    assert text.splitlines()[0] == "Found 55 matching records:" and text.splitlines()[1] == "1. Company: c0; Tags: a, b; Zero: 0"
    assert text.endswith("Showing the first 50 of 55 records.") and "c50" not in text


QUESTIONS = [
    ("Who founded Stripe?", 2), ("Who founded Stripe and RazorPay?", 3), ("Which YC founders from India built fintech companies?", 1), ("Compare AI companies in San Francisco and New York.", 1), ("Which active B2B SaaS companies have fewer than 20 employees?", 1),
    ("Which YC companies use Python and operate in fintech?", 1), ("Which industries are most represented across YC companies?", 4), ("Which investors have the most portfolio companies?", 2), ("Which industries have the most failed (Dead) YC startups?", 1),
    ("How many YC companies are Active vs Dead vs Acquired?", 3), ("What are common patterns among failed YC startups?", 1), ("What is the breakdown of YC companies by stage?", 3), ("Which YC companies were acquired and by whom?", 2), ("Who are the most connected founders across YC?", 1),
    ("Which companies raised Series A funding?", 1), ("What is Stripe's funding history?", 3), ("Which companies raised the most funding rounds?", 1), ("Which technologies are most used by YC companies?", 3), ("How many companies use AI?", 1), ("How many companies use Artificial Intelligence?", 1),
    ("Which companies have more than 500 employees?", 1), ("Who invested in Stripe?", 1), ("Which investors backed both Stripe and RazorPay?", 1), ("What is the survival rate by industry?", 4), ("Which batches have the most payments companies?", 2), ("Which technologies are used by Stripe?", 1),
    ("Can you tell me who founded Stripe? Also tell me who were the founders of RazorPay.", 3), ("Which founders started more than one YC company?", 1), ("What technologies are most commonly used by payments companies?", 2), ("Which investors have the most YC portfolio companies?", 2), ("Which companies use Ruby?", 1), ("Which industries have the most active companies?", 4),
]


@pytest.mark.parametrize("i", range(len(QUESTIONS)))
def test_questions(graph, i):
    question, n = QUESTIONS[i]
    rows, text = Q.ask(graph, question)
    assert rows.count() == n and complaints(question, text) == []


FACETS = [
    ("Which companies are in payments?", None), ("Which payments companies are there?", 2), ("Which active payments companies are headquartered in India?", 1), ("Which AI companies are in San Francisco?", 1), ("Which AI companies compete with Stub?", 0),
    ("Which companies use AI?", 1), ("Which active San Francisco companies are using AI?", 1), ("Which investors invest in payments companies?", 2), ("Which W15 companies are dead?", 1), ("Compare payments companies from S09 vs W15.", 2),
    ("Which active AI companies have fewer than 50 employees?", 0), ("Which dead consumer companies came from S20?", 0), ("Which active companies have more than 500 employees?", 1), ("How many payments companies are there in USA?", 1),
    ("Which companies raised funding but are inactive?", 0), ("Which companies from W15 are public or acquired?", 0), ("Which fintech companies are headquartered in India?", 1), ("Compare payments companies in San Francisco and Bengaluru", 2),
    ("Which companies make nuclear-powered smartphones?", 0), ("Which companies build payments tools?", 0), ("Compare Artificial Intelligence companies in S09 and W15.", 1), ("Which active B2B SaaS companies from the S09 or W15 batches have fewer than 20 employees?", 0), ("Which companies use Kubernetes?", 0), ("Which AI companies are from W21 vs S21?", 0),
]


@pytest.mark.parametrize("i", range(len(FACETS)))
def test_facets(graph, i):
    question, n = FACETS[i]
    if n is None:
        with pytest.raises(Q.UnknownQuestion):
            Q.ask(graph, question)
        return
    rows, text = Q.ask(graph, question)
    assert complaints(question, text) == [] and rows.count() == n


def test_both_names_give_one_count(graph):
    a, b = (Q.ask(graph, f"How many companies use {n}?")[0].collect() for n in ("AI", "Artificial Intelligence"))
    assert a == b and a[0][0] == 1


def test_other_questions_fail_loudly(graph):
    with pytest.raises(Q.UnknownQuestion):
        Q.ask(graph, "What is the meaning of life?")


def test_generators_are_asked_again_with_the_error(graph):
    seen = []

    def generate(question, error, previous):
        seen.append((question, error))
        return "```cypher\nMATCH (c:Company) WHERE c.name = 'Stripe' RETURN c.name AS company\n```" if error is None else 'MATCH (c:Company) WHERE toLower(c.name) = "stripe" RETURN c.name AS company'

    rows, text = Q.ask(graph, "Tell me about Stripe in W23", lambda q, e, p: generate(q, e, p).replace('"stripe"', '"stripe" AND c.yc_batch <> "Winter 2023" OR c.yc_batch = "Winter 2023"'))
    assert rows.count() == 1 and text.endswith("LIMIT 50") and seen[0][0].endswith("Winter 2023") and "case-insensitively" in seen[1][1]
    with pytest.raises(ValueError):
        Q.ask(graph, "Stripe?", lambda q, e, p: "DELETE everything")


def test_classifier(graph):
    assert Q.classify("Who founded stripe?", graph) == "local" and Q.classify("Which industries are largest?", graph) == "global"


def test_service(spark, graph, tmp_path):
    path = str(tmp_path / "log")
    ok = service.ask(graph, "Who founded Stripe?", log_path=path, ip_address="1.2.3.4", api_key="k", expected_key="k")
    assert ok["code"] == 200 and ok["result_count"] == 2 and ok["method"] == "local" and "Patrick" in ok["answer"]
    assert service.ask(graph, "Who?", api_key="x", expected_key="k")["code"] == 401
    assert service.ask(graph, "  Who ")["code"] == 400
    assert service.ask(graph, "What is the meaning of life?", log_path=path)["code"] == 500
    log = spark.read.parquet(path)
    assert {(r["status"], r["result_count"]) for r in log.collect()} == {("success", 2), ("error", None)}
    assert querylog.daily(log).agg(F.sum("n")).collect()[0][0] == 2
    assert service.health() == {"status": "ok"} and service.status(graph)["nodes"]["Company"] == 6
    assert querylog.append(spark, "/proc/nowhere/x", question="x") is False


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("SOME_SETTING", "env")
    assert service.setting(spark, "SOME_SETTING") == "env" and service.setting(spark, "OTHER", "d") == "d"
    with pytest.raises(service.MissingSetting):
        service.setting(spark, "OTHER", required=True)


def test_places(spark):
    requests = spark.createDataFrame([("1.0.0.5",), ("9.9.9.9",), ("::1",), (None,)], "ip_address string")
    ranges = spark.createDataFrame([(2**24, 2**25 + 5, "AU", "Q", "B", 1.0, 2.0)], "start long, end long, country string, region string, city string, latitude double, longitude double")
    assert sorted((r["ip_address"] or "", r["country"], r["latitude"]) for r in querylog.locate(requests, ranges).collect()) == [("", "", None), ("1.0.0.5", "AU", 1.0), ("9.9.9.9", "", None), ("::1", "", None)]
