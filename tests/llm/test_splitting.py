import random

import pytest

from vinculo.llm import splitting as S


def joined(text, limit=100, overlap=20):
    pieces = S.split_text(text, limit, overlap)
    assert all(c - a <= limit for a, _, c in pieces)
    assert all(b - a <= overlap for a, b, _ in pieces)
    assert "".join(text[b:c] for _, b, c in pieces) == text
    return pieces


def test_random_texts_are_whole_and_within_the_limit():
    rng = random.Random(7)
    alphabet = ["a", "bc", " ", ". ", "\n", "\r\n", "\n\n", "。", "é", "é", "👨‍👩‍👧", "😀", "x" * 60]
    for _ in range(60):
        joined("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))))


def test_natural_boundaries_come_first():
    text = "word " * 10 + "\n\n" + "word " * 12
    assert [text[b:c].endswith("\n\n") for _, b, c in joined(text)][0]
    text = "Some words here. " * 12
    assert all(text[b:c].endswith(". ") for _, b, c in joined(text))
    text = "word " * 50
    assert all(text[b:c].endswith(" ") for _, b, c in joined(text))


def test_line_ends_and_joined_characters_stay_together():
    text = ("a" * 29 + "\r\n") * 9
    assert all(not text[b:c].startswith("\n") for _, b, c in joined(text))
    text = "é" * 150
    assert all(text[b:c][0] == "e" for _, b, c in joined(text))


def test_overlap_is_nearly_full():
    text = "abcdefg " * 2000
    pieces = S.split_text(text, 6000, 300)
    assert len(pieces) > 2 and all(200 <= b - a <= 300 for a, b, _ in pieces[1:])


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        S.split_text("x", 10, 10)


def test_table(spark):
    rows = [(1, "short", 0), (2, None, 0), (3, "", 0), (4, "y" * 20_000, 0), (4, "y" * 20_000, 0), (5, "z" * 6000, 0), (6, "z" * 6001, 0)]
    df = spark.createDataFrame(rows, "content_id long, content string, piece int")
    got = S.split(df, "content_id", "content").collect()
    by_id = {k: sum(r["content_id"] == k for r in got) for k in range(1, 7)}
    assert by_id[1] == 1 and by_id[2] == by_id[3] == 0 and by_id[5] == 1 and by_id[6] == 2 and by_id[4] % 2 == 0
    assert {r[0] for r in S.oversized(df, "content_id", "content").collect()} == {4, 6}
    assert S.split(df.limit(0), "content_id", "content").count() == 0
