"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7).

The vocabulary (token bytes and rank) is serialised straight into a sentencepiece BPE model: each byte is mapped to
one printable character, each token becomes a piece whose score is minus its rank, and the normaliser is the identity.
Sentencepiece merges the neighbours with the best score first, which is the order of the ranks, so each pre-token
comes out with the ids of the vocabulary. Pre-tokens repeat a lot; each worker remembers the ids of short ones.

Null and empty texts have the empty list of ids. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY_DIR = os.environ.get("VINCULO_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens kept in a worker's memory and the longest one kept; both only save time.
CACHE_SIZE, CACHE_LENGTH = 300_000, 32


def byte_alphabet() -> list[str]:
    """One printable character for each byte: Latin-1's own where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranked[i] for i in range(len(ranked))]


def serialise(vocabulary: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary in the order of its ranks; the unknown piece gets the next free id."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    alphabet = byte_alphabet()
    model = pb.ModelProto()
    for rank, token in enumerate(vocabulary):
        model.pieces.add(piece="".join(alphabet[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = len(vocabulary), -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class _Known(dict):
    """The ids of pre-tokens as packed 32-bit numbers; what isn't there is encoded and, if short, remembered."""

    def __init__(self, model):
        super().__init__()
        self.encode = model.encode
        self.table = {i: c for i, c in enumerate(byte_alphabet())}

    def __missing__(self, piece: str) -> bytes:
        # latin-1 maps each byte to the character of the same number, which translate() then maps to the alphabet
        ids = array("i", self.encode(piece.encode().decode("latin-1").translate(self.table))).tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts by one vocabulary; made once in each Python worker."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.vocabulary = read_vocabulary(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.vocabulary))
        self.split = regex.compile(PATTERN).findall
        self.ids_of = _Known(self.model).__getitem__

    def pack(self, text: str | None) -> bytes:
        """The ids of a text as packed 32-bit numbers; none for null and empty texts."""
        return b"".join(map(self.ids_of, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.pack(text)).tolist()

    def decode(self, ids) -> str:
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _path(vocabulary_dir: str | None) -> str:
    return os.path.join(vocabulary_dir or VOCABULARY_DIR, VOCABULARY)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, out: str = "ids", vocabulary_dir: str | None = None) -> DataFrame:
    """``id_col`` and the token ids of ``text_col`` for every row, repeated rows included; no shuffle.

    Other columns of ``df`` are ignored, so they may have any name.
    """
    path = _path(vocabulary_dir)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            packed = [own.pack(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
            flat = np.frombuffer(b"".join(packed), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, out: str = "n_tokens", vocabulary_dir: str | None = None) -> DataFrame:
    """``id_col`` and the number of tokens of ``text_col``; 0 for null and empty texts."""
    path = _path(vocabulary_dir)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            counts = pa.array([len(own.pack(t)) // 4 for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` int")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, out: str = "text", vocabulary_dir: str | None = None) -> DataFrame:
    """The texts of lists of ids; a null list has the null text."""
    path = _path(vocabulary_dir)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, out])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{out}` string")
