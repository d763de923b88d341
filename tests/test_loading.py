import json

import pytest
from pyspark.sql import functions as F

from vinculo.catalog import Graph
from vinculo.operators import enrichment, mutation
from vinculo.sources import loader, propgraph
from vinculo.streaming.incremental import load_new, loaded_graph, windowed_counts


def doc(name, **more):
    return json.dumps({"company": {"name": name, "status": "Active", "stage": "Early", "team_size": 3, "yc_batch": "Winter 2015", "description": "d"}} | more)


DOCS = [
    ("a.txt", doc("Alpha", founders=["Ann", "Bob", None, "Cid"], investors=["Vee"], industries=["Payments"], technologies=["Go"], locations=[{"city": "", "country": "India"}, {"city": "Rome", "country": None}],
                  acquisitions=[{"acquirer": "Ghost", "year": None, "amount": ""}], funding_rounds=[{"round": "A", "year": 2020, "amount": "1M"}, {"round": "A", "year": 2020, "amount": "2M"}, {"round": None, "year": None, "amount": None}], competitors=["Rival", "Beta"])),
    ("b.txt", doc("Beta", founders=["Bob", "Ann"], competitors=None)),
    ("c.txt", json.dumps({"company": {"name": "Alpha", "status": None, "team_size": 9}})),
    ("d.txt", json.dumps({"company": {"name": ""}})),
    ("e.txt", "not json"),
    ("o-neil_3m foo.txt", json.dumps({"founders": ["Zoe"]})),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return loader.parse_documents(spark.createDataFrame(DOCS, "filename string, content string")).cache()


@pytest.fixture(scope="module")
def graph(parsed):
    return loader.build(parsed)


def pairs(graph, kind):
    s, d = graph.endpoint_labels(kind)
    name = lambda label, end: graph.node(label).select(F.col("node_id").alias(end), F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (("city", "country") if label == "Location" else ("round", "year", "company") if label == "FundingEvent" else ("name",))]).alias(f"{end}_name"))
    return {(r["src_name"], r["dst_name"]) for r in graph.edge(kind).join(name(s, "src"), "src").join(name(d, "dst"), "dst").collect()}


def test_problems(parsed):
    assert {r["filename"]: r["problem"] for r in parsed.collect()} == {"a.txt": None, "b.txt": None, "c.txt": None, "d.txt": "no company name", "e.txt": "bad json", "o-neil_3m foo.txt": None}
    assert {r["status"]: r["n"] for r in loader.run_summary(parsed).collect()} == {"loaded": 4, "no company name": 1, "bad json": 1}


def test_companies(graph):
    got = {r["name"]: r for r in graph.node("Company").collect()}
    assert set(got) == {"Alpha", "Beta", "Ghost", "Rival", "O Neil 3M Foo"}
    # the later file wins, a null it states stays null, what it doesn't name has its default
    assert (got["Alpha"]["team_size"], got["Alpha"]["status"], got["Alpha"]["stage"], got["Alpha"]["filename"]) == (9, None, "Unknown", "c.txt")
    assert got["Ghost"]["status"] is None and got["Beta"]["status"] == "Active"


def test_edges(graph):
    assert pairs(graph, "FOUNDED") == {("Ann", "Alpha"), ("Bob", "Alpha"), ("Cid", "Alpha"), ("Ann", "Beta"), ("Bob", "Beta"), ("Zoe", "O Neil 3M Foo")}
    assert pairs(graph, "CO_FOUNDED_WITH") == {("Ann", "Bob"), ("Ann", "Cid"), ("Bob", "Cid"), ("Bob", "Ann")}
    assert pairs(graph, "HEADQUARTERED_IN") == {("Alpha", "Unknown/India")}
    assert pairs(graph, "RAISED") == {("Alpha", "A/2020/Alpha"), ("Alpha", "Unknown/0/Alpha")}
    assert {r["amount"] for r in graph.edge("RAISED").collect()} == {"2M", "unknown"} == {r["amount"] for r in graph.node("FundingEvent").collect()}
    assert [(r["year"], r["amount"]) for r in graph.edge("ACQUIRED_BY").collect()] == [(0, "unknown")]
    assert pairs(graph, "COMPETES_WITH") == {("Alpha", "Rival"), ("Alpha", "Beta")}
    assert mutation.dangling(graph).count() == 0


def test_reload_gives_the_same_graph(spark, parsed, graph):
    again = loader.build(parsed)
    for kind in graph.edges:
        assert {tuple(r) for r in graph.edge(kind).collect()} == {tuple(r) for r in again.edge(kind).collect()}


def test_empty_input(spark):
    g = loader.build(loader.parse_documents(spark.createDataFrame([], "filename string, content string")))
    assert g.label_histogram().count() == 0 and g.all_edges().count() == 0


def test_files_and_manifest(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo"), ("b.txt", "  "), ("c.md", "no")):
        (tmp_path / name).write_text(text)
    files = loader.read_texts(spark, str(tmp_path))
    assert [(r["filename"], r["content"]) for r in files.collect()] == [("a.txt", "one\ntwo")]
    done = spark.createDataFrame([("a.txt", "failed")], "filename string, status string")
    loader.append_manifest(done, str(tmp_path / "m"))
    manifest = spark.read.parquet(str(tmp_path / "m"))
    assert loader.unprocessed(files, manifest).count() == 1 and loader.unprocessed(files, manifest, retry_failed=False).count() == 0


def test_stream_loads_each_file_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.txt").write_text(DOCS[0][1])
    load_new(spark, str(folder), out, check)
    (folder / "b.txt").write_text(DOCS[1][1])
    (folder / "e.txt").write_text("broken")
    load_new(spark, str(folder), out, check)
    load_new(spark, str(folder), out, check)
    assert {(r["filename"], r["status"]) for r in spark.read.parquet(f"{out}/manifest").collect()} == {("a.txt", "loaded"), ("b.txt", "loaded"), ("e.txt", "failed")}
    assert spark.read.parquet(f"{out}/documents").count() == 3
    assert loaded_graph(spark, out).node("Company").count() == 4


def test_windows_of_a_stream_match_the_table(spark, tmp_path):
    events = spark.range(50).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("windows").collect()} == {tuple(r) for r in windowed_counts(events).collect()}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (5, "b", 2)], "node_id long, name string, x int")
    new = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("c", 3, 1), (None, 4, 1)], "name string, x int, at int")
    got = {r["name"]: r for r in mutation.upsert_nodes(old, new, ["name"], [F.col("at")]).collect()}
    assert {k: r["x"] for k, r in got.items()} == {"a": 11, "b": 2, "c": 3} and got["a"]["node_id"] == 1 and got["c"]["node_id"] > 5
    made = {r["name"]: r["x"] for r in mutation.get_or_create(old, new, ["name"]).collect()}
    assert made == {"a": 1, "b": 2, "c": None}
    e = lambda rows: spark.createDataFrame(rows, "edge_id long, src long, dst long, w string")
    merged = lambda over: {(r["src"], r["dst"]): (r["edge_id"], r["w"]) for r in mutation.merge_edges(e([(1, 1, 2, "old")]), e([(7, 1, 2, "new"), (8, 3, 4, "x")]), overwrite=over).collect()}
    assert merged(True) == {(1, 2): (1, "new"), (3, 4): (8, "x")} and merged(False) == {(1, 2): (1, "old"), (3, 4): (8, "x")}


def test_merge_and_delete(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "node_id long, name string")
    rival = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 3, 2), (5, 3, 3)], "edge_id long, src long, dst long")
    g = Graph(spark, {"Company": nodes}, {"COMPETES_WITH": rival})
    m = mutation.merge_nodes(g, "Company", spark.createDataFrame([(2, 1), (1, 1)], "node_id long, into long"))
    assert {r["name"] for r in m.node("Company").collect()} == {"A", "C"}
    # the edge between both is gone, parallel ones are one and keep the older, the untouched loop stays
    assert {(r["edge_id"], r["src"], r["dst"]) for r in m.edge("COMPETES_WITH").collect()} == {(3, 1, 3), (4, 3, 1), (5, 3, 3)}
    again = mutation.merge_nodes(m, "Company", spark.createDataFrame([(2, 1)], "node_id long, into long"))
    assert {tuple(r) for r in again.edge("COMPETES_WITH").collect()} == {tuple(r) for r in m.edge("COMPETES_WITH").collect()}
    d = mutation.detach_delete(g, "Company", spark.createDataFrame([(3,)], "node_id long"))
    assert [r["edge_id"] for r in d.edge("COMPETES_WITH").collect()] == [1] and mutation.dangling(d).count() == 0


def test_generic_graphs(spark):
    a = {"nodes": [{"id": "x", "label": "Startup", "description": "one", "team_size": None, "extra_attributes": [{"key": "k", "value": "1"}, {"key": "k", "value": "2"}, {"key": "", "value": "3"}, {"key": "description", "value": "extra"}]}, {"id": "y", "label": "Person", "extra_attributes": None}, {"id": None, "label": "Lost"}],
         "edges": [{"source": "y", "target": "x", "relationship": "FOUNDED", "valuation": "5"}, {"source": "y", "target": "nobody", "relationship": "KNOWS"}]}
    b = {"nodes": [{"id": "x", "label": "Startup", "team_size": "4"}], "edges": [{"source": "y", "target": "x", "relationship": "FOUNDED", "share_price": "1"}]}
    raw = spark.createDataFrame([("a.txt", json.dumps(a)), ("b.txt", json.dumps(b)), ("c.txt", "broken")], "filename string, content string")
    nodes, edges = propgraph.upsert(*propgraph.read_graphs(raw))
    assert {r["id"]: r["props"] for r in nodes.collect()} == {"x": {"description": "extra", "k": "2", "team_size": "4"}, "y": {}}
    assert [(r["src"], r["dst_label"], r["props"]) for r in edges.collect()] == [("y", "Startup", {"valuation": "5", "share_price": "1"})]
    assert spark.createDataFrame([("Big Co.txt",)], "f string").select(propgraph.entity_id(F.col("f"))).collect()[0][0] == "big_co"


def test_enrichment(spark):
    long = "Alpha is a firm. " * 30
    profiles = spark.createDataFrame([("a.txt", "x\nYC Startup Profile: Alpha\nmore"), ("beta-co.txt", "text"), ("gamma.txt", "text"), ("delta.txt", None)], "filename string, text string")
    pages = spark.createDataFrame([("Alpha Inc", long), ("Beta Co", "too short"), (None, long), ("Empty", "")], "title string, extract string")
    got = {r["filename"]: r for r in enrichment.enrich(profiles, pages).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a.txt": "enriched", "beta-co.txt": "irrelevant", "gamma.txt": "not_found", "delta.txt": "not_found"}
    assert got["a.txt"]["text"].endswith(long) and "wiki/Alpha_Inc\n" in got["a.txt"]["text"] and got["beta-co.txt"]["text"] == "text"
    search = spark.createDataFrame([("Gamma", "Alpha Inc")], "query string, title string")
    assert {r["filename"]: r["status"] for r in enrichment.enrich(profiles, pages, search).collect()}["gamma.txt"] == "irrelevant"


def test_titles(spark):
    got = spark.createDataFrame([("o'neil 3m-foo_bar.txt",), ("élan.x.txt",)], "f string").select(loader.file_title(F.col("f"))).collect()
    assert [r[0] for r in got] == ["O'Neil 3M Foo Bar", "Élan.X"]


def test_extractors(spark):
    texts = spark.createDataFrame([("alpha-co.txt", "About Alpha"), ("b.txt", "boom"), ("c.txt", "nothing"), ("d.txt", "text")], "filename string, content string")

    def extractor(text, title):
        if text == "boom":
            raise ValueError
        return {"company": {"name": title}} if "About" in text else None if text == "nothing" else "not json"

    parsed = loader.parse_documents(loader.extract(texts, extractor))
    assert {r["filename"]: (r["problem"], r["company"]["name"]) for r in parsed.collect()}["alpha-co.txt"] == (None, "Alpha Co")
    assert {r["problem"] for r in parsed.where("filename <> 'alpha-co.txt'").collect()} == {"bad json"}
    made = propgraph.extract(texts.limit(1), lambda text, title: {"nodes": [{"id": "whatever", "label": "Startup"}, {"id": "y", "label": "Person"}], "edges": [{"source": "y", "target": "whatever", "relationship": "FOUNDED"}]})
    nodes, edges = propgraph.upsert(*propgraph.read_graphs(made))
    assert {r["id"] for r in nodes.collect()} == {"alpha_co", "y"} and edges.collect()[0]["dst"] == "alpha_co"


def test_enrichment_resumes(spark, tmp_path):
    profiles = spark.createDataFrame([("alpha.txt", "text"), ("beta.txt", "text")], "filename string, text string")
    pages = spark.createDataFrame([("Alpha", "Alpha is a firm. " * 30)], "title string, extract string")
    first = enrichment.resume(profiles.where("filename = 'alpha.txt'"), pages, profiles.limit(0))
    enrichment.write_enriched(first, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["filename"]: r["status"] for r in enrichment.resume(profiles, pages, out).collect()} == {"alpha.txt": "already_done", "beta.txt": "not_found"}
