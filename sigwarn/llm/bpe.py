"""Byte-level BPE with a SentencePiece model that is serialised from the vocabulary of ranks.

Bytes are mapped to printable characters, so that every token is a piece of text; a piece's score is its negative
rank, so SentencePiece joins the neighbours of lowest rank first, as the byte-level method does; normalisation is the
identity. Texts are cut into pre-tokens by the tokenizer's pattern, each encoded by itself. A pre-token that is a
token as a whole is that token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwarn.llm.store import id_of_any_name

#: Bytes of pre-tokens and their ids that a task keeps, about, beside those of one text; when full it starts anew.
CACHED_BYTES = 64 << 20
#: Bytes of an entry besides its characters and ids, about.
ENTRY_BYTES = 200


def read_ranks(path: str) -> list[bytes]:
    """The tokens in order of rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    return [base64.b64decode(t) for t, _ in sorted(pairs, key=lambda p: int(p[1]))]


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A SentencePiece BPE model whose piece k is token k; the last piece is the unknown one."""
    characters = byte_characters()
    pieces = [_field(1, "".join(characters[b] for b in t).encode()) + _field(2, -float(k)) + _field(3, 1) for k, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes such ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens, self.find = tokens, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.whole = {t: struct.pack("<I", k) for k, t in enumerate(tokens)}
        self.map = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            parts = self.find(text)
            cache = self.cache
            missing = [p for p in set(parts) if p not in cache]
            if missing:
                if self.held > CACHED_BYTES:
                    cache, self.held = {}, 0
                    self.cache, missing = cache, list(set(parts))
                self._learn(missing)
            yield b"".join(map(cache.__getitem__, parts))

    def _learn(self, parts: list[str]) -> None:
        split = []
        for p in parts:
            raw = p.encode()
            if raw in self.whole:
                self.cache[p] = self.whole[raw]
            else:
                split.append((p, raw.decode("latin-1").translate(self.map)))
        for (p, _), ids in zip(split, self.model.encode([m for _, m in split], num_threads=1) if split else [], strict=True):
            self.cache[p] = np.asarray(ids, dtype="<u4").tobytes()
        self.held += sum(4 * len(p) + len(self.cache[p]) + ENTRY_BYTES for p in parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def shared_codec(name: str, pattern: str) -> Codec:
    """One codec for all tasks of a Python worker; name is that of a file that was sent to the executors."""
    return Codec(read_ranks(SparkFiles.get(name)), pattern)


@id_of_any_name("n_tokens", "ids", "ids_sha256", "decoded_sha256")
def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """The id of every row with its text's ids; with digests: n_tokens, ids_sha256, decoded_sha256 instead of ids.

    vocabulary is the path of a file of ranks, which goes to the executors as a file. Null texts count as empty: they
    have no ids. A null id stays null. Repeated rows are encoded each. An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(name, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = codec.encode(pc.fill_null(part.column(1), "").to_pylist())
                if digests:
                    rows = [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(codec.decode(x)).hexdigest()) for x in coded]
                    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coded]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {out}")


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the decoded bytes of every row; a null list counts as empty."""
    spark = coded.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(SparkFiles.get(name))
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return coded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
