import pytest
from pyspark.sql import functions as F

from vinculo.llm import residue as R

CONTENT = "Revenue grew by 77% in 2020, then slowed when two pilot contracts ended. Most customers are small clinics, although tour guides now make up 30% of revenue."
BAD = [
    "Error 404 We could not find that page. Check the spelling of the address.", "Menu Search Log in\nSorry, no profile matches this address.\n© All rights reserved", "Pleyo Wosto\nxxx xxx xxx xxx xxx xxx xxx xxx xxx.",
    "Loading Traispaspoli…\n<noscript>Activate JavaScript and cookies to continue</noscript>", '{"message": "not found", "code": 404}', "Access denied. Sign in to continue.", "Under construction! We are still writing this profile.",
    "Field 1: text\nFeature 2: description\nQuestion 3: to be written", "Ipsum lorem dolor sit amet quam tempus. Lorem sapien mattis dolor amet vel.", "404\nアクセスが拒否されました。", "Diese Anwendung benötigt JavaScript.", "Página não encontrada. O endereço pedido não existe.",
    "Hier steht bald ein Text. Dies ist nur ein Blindtext, der den Platz füllt. (2)", "Staff own {0} of the shares. " + CONTENT, "Founded in <%= year %> by someone. " + CONTENT, "[insert amount here] was raised in 2010. " + CONTENT, "Two patents on {{{thing|default}}} were granted.", "売上は2023年に<金額>伸びた。",
]
GOOD = [
    CONTENT, "With Jiprolume, a mail template such as `Hello {{first_name}}` is filled from a sheet. " + CONTENT, "The syntax is small. Write ${price} in a cell and it looks the number up; write [[shelf]] and it prints a label.\n\n```\ntotal: ${price} x {count}\n```\n" + CONTENT,
    "The office in Lusmigai is still under construction, yet 87 people already work there. " + CONTENT, "It counts every 502 and 503 answer; last year it saw 13 million of them. " + CONTENT, "Its browser plug-in asks users to enable JavaScript only for sites that it has audited. " + CONTENT,
    "The firm built the trackers itself [26]. " + CONTENT, None, "", " \n\t", "​", "The name <Dusta Gloge> is written with angle brackets in the logo, and the fund is quoted as {DUSTA GLOGE} on the board. " + CONTENT,
]


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(BAD + GOOD)] + [(1000 + i, CONTENT) for i in range(30)] + [(None, BAD[0])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, mask string, template int")
    assert {r[0] for r in R.residue(df).collect()} == set(range(len(BAD)))


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([(1, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(200_000)) + "."), (2, "test " * 50_000), (2, "test " * 50_000)], "doc_id long, text string")
    assert [r[0] for r in R.residue(df).collect()] == [2]
    assert R.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", BAD)
def test_hints_cover_the_patterns(text):
    for s in text.split("\n"):
        assert not R.MESSAGES.search(s) or any(h in s.lower() for h in R.HINTS)


def test_tree_joins_what_differs_little():
    tree = R.Tree()
    ids = [tree.add(s.split()) for s in ("the page a was not found", "the page b was not found", "a b c d e f")]
    assert ids == [0, 0, 1] and tree.templates[0] == "the page * was not found".split()


def test_templates_carry_the_verdict(spark, monkeypatch):
    """A wording that no pattern knows is a message by its template; without the tree it isn't found."""
    texts = ["Sadly the piece you look for at this link was not found", "Sadly the piece you look for at this link was not spotted", CONTENT]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0] for r in R.residue(df).collect()} == {0, 1}
    monkeypatch.setattr(R, "SIMILARITY", 1.01)
    monkeypatch.setattr(R, "MESSAGE_SIMILARITY", 1.01)
    assert {r[0] for r in R.residue(df).collect()} == {0}


def test_verdicts_do_not_depend_on_other_rows(spark):
    texts = ["404", "Error 503", "100", "Error 12", "Please write to {{support_email}} for help.", "Our startup uses tags from {{company_name}}", "Ask {{" + "x" * 61 + "}} for it.", "Please " + "word of this and that " * 12 + "enable JavaScript to go on with it."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r[0] for r in R.residue(df).collect()} == {0, 1, 4, 5, 6, 7}


def test_a_lone_content_sentence_is_content(spark):
    df = spark.createDataFrame([(1, "The clinic of the town buys twelve of them each year for its wards. Its old page was not found.")], "doc_id long, text string")
    assert R.residue(df).count() == 0


def test_large_leaves_are_mined_in_parts(spark, monkeypatch):
    rows = [(i, f"the page of shop {chr(97 + i)} was not found", 1, 1) for i in range(20)] + [(100 + i, f"the page of shop {chr(97 + i)} sells {chr(97 + i)} things", 1, 0) for i in range(20)]
    masks = spark.createDataFrame(rows, "mask_id long, mask string, n long, verdict int")
    whole = {r["mask_id"]: r["message"] for r in R.mine(masks).collect()}
    monkeypatch.setattr(R, "LEAF_MASKS", 5)
    parts = R.mine(masks).collect()
    assert {r["mask_id"]: r["message"] for r in parts} == whole == {i: i < 100 for i, *_ in rows}
    assert len({r["template"] for r in parts if r["message"]}) == 1


def test_segments(spark):
    got = spark.createDataFrame([("One. Two!\r\nThree。Four",)], "t string").select(R.segments(F.col("t")).alias("s")).collect()[0]["s"]
    assert [x for x in got if x] == ["One.", "Two!", "Three。", "Four"]
