"""Lines that many documents share, dropped everywhere but in one document; verdicts travel as bitmaps, texts don't.

A line's key is the line without white space at its ends and with A-Z lower-cased; it goes by a 128-bit cryptographic
digest, so that two different keys are taken for one with a chance below 1e-14 among 10^12 of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwarn.llm.store import SLOTS, fresh, materialize

#: Keys of at least LEAST_CHARS code points found in at least LEAST_DOCS documents are dropped.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Lines that a task holds before it hands on what it knows of them.
PENDING = 200_000
_SPACE = b" \t\n\x0b\x0c\r"


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def _later(x: object) -> tuple:
    """Orders ids: null before any other."""
    return (x is not None, x if x is not None else 0)


class _Pending:
    """The keys of some documents: {digest: {(id, version): places}}."""

    def __init__(self, least_chars: int, least_docs: int) -> None:
        self.least_chars, self.least_docs, self.keys, self.size = least_chars, least_docs, {}, 0

    def add(self, who: object, version: int, text: bytes) -> int:
        """Takes in a document and returns its number of lines."""
        lines = text.split(b"\n")
        for at, line in enumerate(lines):
            if len(line) >= self.least_chars:
                key = line.strip(_SPACE).lower()
                if _long_enough(key, self.least_chars):
                    self.keys.setdefault(hashlib.blake2b(key, digest_size=16).digest(), {}).setdefault((who, version), []).append(at)
                    self.size += 1
        return len(lines)

    def handed_on(self) -> Iterator[tuple]:
        """(key, id, version, places, documents) of what has to meet the other tasks' lines; with no key, of what goes for sure.

        A key in enough of these documents loses its lines in all of them but the one with the largest id: whatever
        other tasks hold, none of the others is the last. So of a key in a third of all documents each task hands on one.
        """
        for key, found in self.keys.items():
            ids = {who for who, _ in found}
            last = max(ids, key=_later) if len(ids) >= self.least_docs else None
            for (who, version), places in found.items():
                if len(ids) < self.least_docs or who == last:
                    yield key, who, version, places, min(len(ids), self.least_docs) if len(ids) >= self.least_docs else 1
                else:
                    yield None, who, version, places, 0
        self.keys, self.size = {}, 0


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def line_keys(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(key, id, version, places, documents, n_lines) of docs(id, version, text): one row per key and document that has to be
    compared, one without key for lines that go for sure, and one with n_lines for every document."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, id_type, heads = _Pending(least_chars, least_docs), None, []
        names = ["key", "id", "version", "places", "documents", "n_lines"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return _table(rows, names, [pa.binary(), id_type, pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for who, version, text in zip(batch.column("id").to_pylist(), batch.column("version").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                heads.append((None, who, version, None, None, pending.add(who, version, raw)))
                if pending.size >= PENDING:
                    yield out([(*row, None) for row in pending.handed_on()])
            yield out(heads)
            heads = []
        if pending.size:
            yield out([(*row, None) for row in pending.handed_on()])

    return docs.mapInArrow(run, f"key binary, id {kind}, version long, places array<int>, documents int, n_lines long")


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first isn't the one before; nulls are equal to each other."""
    a, b = column[1:], column[:-1]
    unequal = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def first_occurrences(keys: DataFrame, least_docs: int) -> DataFrame:
    """(id, version, places) of lines that go, from keys(key, id, version, places, documents).

    Keys are dealt out by ranges and sorted by document within them, the largest first, so a task reads a key's
    documents in a row: the first stays, the others go once enough documents have been seen. Until then the few
    documents in between are held back.
    """
    kind = keys.schema["id"].dataType.simpleString()
    dealt = keys.repartitionByRange("key").sortWithinPartitions("key", F.desc_nulls_last("id"), "version")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = last = None
        seen, held, enough = 0, [], False
        for batch in batches:
            gone, ids = [], batch.column("id")
            rows = zip(batch.column("key").to_pylist(), ids.to_pylist(), batch.column("version").to_pylist(), batch.column("places").to_pylist(), batch.column("documents").to_pylist(), strict=True)
            for row_key, who, version, places, documents in rows:
                if row_key != key:
                    key, first, last, seen, held, enough = row_key, who, who, 1, [], False
                elif who != last:
                    last, seen = who, seen + 1
                enough = enough or documents >= least_docs or seen >= least_docs
                if who != first:
                    held.append((who, version, places))
                if enough and held:
                    gone += held
                    held = []
            yield _table(gone, ["id", "version", "places"], [ids.type, pa.int64(), pa.list_(pa.int32())])

    columns = dealt.select("key", "id", "version", "places", "documents")
    return columns.mapInArrow(run, f"id {kind}, version long, places array<int>")


def pack_bits(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), bitorder="little", count=n).astype(bool)


def _version(text: Column) -> Column:
    return F.xxhash64(text)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, version, n_lines, n_dropped, keep): a compressed bitmap of the lines that stay, for every document.

    Texts are read once, where they are. A key of at least least_chars code points in at least least_docs documents
    loses all its lines but those of the document with the largest id. version is the text's hash: rows that repeat an id are
    one document, with one bitmap per text; an equal row gets no second one. Null and empty texts have one
    empty line, which stays. A null id loses to any other; all rows with a null id are one document. An empty table
    gives an empty result; other columns are not looked at. A document's line numbers must fit one task.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _version(F.col(text_col)).alias("version"), F.col(text_col).cast("string").alias("text"))
    found = materialize(line_keys(rows, least_chars, least_docs))
    gone = first_occurrences(found.where("key is not null"), least_docs)
    certain = found.where("key is null").select("id", "version", "places", "n_lines")
    both = certain.unionByName(gone.withColumn("n_lines", F.lit(None).cast("long")))
    whole = both.groupBy("id", "version").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("places")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped, packed = [], []
            for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
                keep = np.ones(n, dtype=bool)
                keep[gone.values.to_numpy(zero_copy_only=False)] = False
                dropped.append(int(n - keep.sum()))
                packed.append(pack_bits(keep))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "version", "n_lines")], pa.array(dropped, pa.int64()), pa.array(packed, pa.binary())], ["id", "version", "n_lines", "n_dropped", "keep"])

    return whole.mapInArrow(run, f"id {kind}, version long, n_lines long, n_dropped long, keep binary")


def _with_kept_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, dropped: str) -> DataFrame:
    """docs with the text that its bitmap leaves and the number of lines that it drops, as `dropped`.

    Only documents in the slot of one that loses lines are shuffled; the taken slots are broadcast, at most SLOTS numbers.
    """
    slot, taken, own, who, version, keep = fresh(docs.withColumn(dropped, F.lit(0)), "_slot", "_taken", "_own", "_who", "_version", "_keep")
    slot_of = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    touched = materialize(bitmaps.where("n_dropped > 0").select(F.col("id").alias(who), F.col("version").alias(version), F.col("keep").alias(keep), F.col("n_dropped").alias(dropped)))
    slots = materialize(touched.select(slot_of(F.col(who)).alias(taken)).distinct())
    dealt, met = docs.withColumn(slot, slot_of(F.col(id_col))), F.col(slot) == F.col(taken)
    rest = dealt.join(F.broadcast(slots), met, "left_anti").drop(slot).withColumn(dropped, F.lit(0).cast("long"))
    near = dealt.join(F.broadcast(slots), met, "left_semi").drop(slot).withColumn(own, _version(F.col(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(who)) & (F.col(own) == F.col(version))
    joined = near.join(touched, on, "left").withColumn(dropped, F.coalesce(F.col(dropped), F.lit(0))).drop(own, who, version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, packed in zip(batch.column(text_col).to_pylist(), batch.column(keep).to_pylist(), strict=True):
                if packed is not None:
                    lines = text.split("\n")
                    text = "\n".join(line for line, stays in zip(lines, unpack_bits(packed, len(lines)), strict=True) if stays)
                texts.append(text)
            field = batch.schema.field(text_col)
            yield batch.set_column(batch.schema.get_field_index(text_col), field, pa.array(texts, field.type)).drop_columns([keep])

    return rest.unionByName(joined.mapInArrow(run, rest.select(*joined.drop(keep).columns).schema))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns and rows, with the lines that line_bitmaps() of the same rows leaves, joined by line ends.

    Null texts stay null; a document that loses all lines becomes empty. Columns may have any names.
    """
    (dropped,) = fresh(docs, "_dropped")
    return _with_kept_lines(docs, bitmaps, id_col, text_col, dropped).select(*docs.columns)


def digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines, n_dropped, kept_sha256 of each row of docs."""
    own, dropped, lines, sha = fresh(docs.select(id_col, text_col), "_text", "n_dropped", "n_lines", "kept_sha256")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias(own), (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias(lines))
    kept = _with_kept_lines(rows, bitmaps, id_col, own, dropped)
    return kept.select(id_col, lines, dropped, F.sha2(F.coalesce(F.col(own), F.lit("")).cast("binary"), 256).alias(sha))
