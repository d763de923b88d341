import base64
import random

import pytest

from vinculo.llm import bpe

TEXTS = ["", None, "Hello world", "  two  spaces\n\n\ttab ", "don't I'll we've", "日本語のテキスト。", "é combining", "\x00\x01\x7f control ​", "👨‍👩‍👧 emoji", "x" * 5000, "1234567890" * 50, "<|endoftext|>", "Ünïcödé—“quotes”"]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe._path(None), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_another_encoder(reference):
    own = bpe.encoder(bpe._path(None))
    rng = random.Random(8)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3040, 0x30FF), rng.randrange(0x1F300, 0x1F5FF)])) for _ in range(200)) for _ in range(20)]
    for t in TEXTS + noise:
        assert own.encode(t) == reference.encode_ordinary(t or "")
        assert own.decode(own.encode(t)) == (t or "")


def test_cache_may_overflow(monkeypatch, reference):
    own = bpe.Encoder(bpe._path(None))
    monkeypatch.setattr(bpe, "CACHE_SIZE", 3)
    for t in TEXTS * 2:
        assert own.encode(t) == reference.encode_ordinary(t or "")


def test_tables(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(df.limit(0)).count() == 0
    assert bpe.encode(df).schema["ids"].dataType.simpleString() == "array<int>"


def test_alphabet_is_one_to_one():
    a = bpe.byte_alphabet()
    assert len(set(a)) == 256 and all(not c.isspace() for c in a)
