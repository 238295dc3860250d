"""Exact Jaccard similarity join of n-word shingle sets by vertical partitioning.

All shingles have one global order, that of their 64-bit hashes. It is cut into fragments, so that every set is cut
into pieces that only meet the same fragment of another set.

Candidates. Two sets with similarity of t or more differ in at most d = (1-t)/(1+t) of their summed sizes. With
d + 1 + spare fragments at least 1 + spare pieces are identical in both, so sets that share fewer whole pieces with
others are no candidates. The number of fragments depends on a class of sizes; a set is cut for its own class and for
the next, as similar sets lie in the same or in neighbouring classes. Empty pieces are looked at only by sets with
more than `spare` of them: others have another piece in common with all that are similar.

Counts. For candidate pairs, overlaps are counted in each of FRAGMENTS fragments on their own and summed per pair.
A shingle that no other candidate has can't be matched, which bounds a pair's overlap before it is counted.

Groups of copies. Equal sets are one class from the start. A piece that many sets share first gives links to one of
them only, that with most in common with all others. Then pieces of sets that are not connected yet are looked at. A
set lists its rarest ones, as many as reach to meet all similar sets. In small groups, pairs that can be similar are
compared. In large ones, sets are described by their difference from one set of the component that holds most of the
group, sets outside that component meet others only where their descriptions do, and sets inside it don't meet each
other. A pair is left out only if it is in one component already or can't be similar, so components are exact and no
group is expanded into all its pairs.

A set is known by 64 bits of its hashes; 64 others tell whether two sets have the same number, and then another number
is taken for all. Two shingles with one 64-bit hash count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.llm.components import components
from sigwarn.llm.store import discard, id_of_any_name, kept_rows, materialize
from sigwarn.llm.words import Words, byte_blocks, mix, shingle_sets

#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: Bits of the largest prefilter that goes to the executors: 8 MB. Beyond, it lets more rows through; joins decide.
MOST_BITS = 1 << 26
#: Sets of one piece up to which all their pairs are looked at; larger groups are compared by what they differ in.
SMALL = 16

_ONE = np.uint64(1)


def size_classes(percent: int, most: int) -> np.ndarray:
    """Lower bounds of the classes of sizes up to `most` and two more: sizes whose ratio is percent/100 or more are in the same or neighbouring classes."""
    bounds = [1]
    while len(bounds) < 3 or bounds[-3] <= most:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    return np.array(bounds, dtype=np.int64)


def identity(found: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit number for a set; equal sets have the same."""
    total = mix(found + np.uint64(seed)).sum(dtype=np.uint64) if len(found) else np.uint64(0)
    return int(mix(np.array([total + np.uint64(len(found))]))[0].view(np.int64))


def pieces(found: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(class, least number of them that a similar set has, keys of the pieces) of a sorted set for both its classes."""
    n = len(found)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
    high, out = found >> np.uint64(32), []
    for group in (own, own + 1):
        differ = 2 * int(bounds[group + 1] - 1) * (100 - percent) // (100 + percent)
        spare = 1 + differ // 6
        k = differ + 1 + spare
        cut = np.searchsorted(high, (np.arange(k + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(k))
        cut[-1] = n
        key = mix(mix(total[cut[1:]] - total[cut[:-1]]) + (np.arange(k, dtype=np.uint64) << np.uint64(32)) + np.uint64(group))
        full = cut[1:] > cut[:-1]
        empty = k - int(full.sum())
        out.append((group, 1, key) if empty > spare else (group, 1 + spare - empty, key[full]))
    return out


def _prefilter(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap with the bits of the keys, of a bounded size: 32 bits a key, up to MOST_BITS."""
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (32 * keys.count()).bit_length()))
    place = F.col(name).bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(place, 5).alias("w"), F.expr(f"shiftleft(1L, cast({name} & 31 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 5, dtype=np.uint32)
    out[np.asarray(found["w"])] = np.asarray(found["b"]).astype(np.uint32)
    return out


def _passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(len(bitmap) * 32 - 1)
    return (bitmap[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, data, offsets in byte_blocks(batch.column("text")):
        for i, found in enumerate(shingle_sets(Words(data, offsets), n)):
            yield at + i, found


def _numbered(texts: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """(id, n, set_id) of all rows, the seed of set_id, and the largest n. Different sets have different numbers."""
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n long, set_id long, other long"
    seed = 0
    while True:

        def numbers(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(len(s), identity(s, seed), identity(s, ~seed & 0xFFFFFFFF)) for _, s in _sets(batch, n)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]], names=["id", "n", "set_id", "other"])

        base = materialize(texts.mapInArrow(numbers, schema))
        once = base.groupBy("set_id").agg(F.max("n").alias("n"), (F.min("other") < F.max("other")).alias("several"))
        most, several = once.agg(F.max("n"), F.max("several")).first()
        if not several:
            return base, seed, most or 1
        discard(base)
        seed += 1


@id_of_any_name("n_shingles", "component_id", "n_links")
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, n_links of every row of docs, where similarity >= percent/100 links.

    A text with fewer than n words is one shingle; one without words (null too) has none and is linked with nothing.
    component_id is the smallest id that links reach; n_links counts the verified links of the row's class of equal
    sets that were needed to connect it. Ids may have any type with an order, texts of one id may repeat. Repeated rows
    are copies of each other. Rows with a null id take part and get the smallest id of their component. An empty table
    gives an empty result; other columns are not looked at. The result is a table in the shared folder.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, seed, most = _numbered(texts, n)
    bounds = size_classes(percent, most)

    def keys_of(bitmap=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, facts = [np.zeros(0, np.uint64)], []
                for _, s in _sets(batch, n):
                    if len(s):
                        sid = identity(s, seed)
                        for group, need, key in pieces(s, bounds, percent):
                            keys.append(key if bitmap is None else key[_passes(bitmap.value, key)])
                            facts.append((sid, len(s), group, need, len(keys[-1])))
                table = np.array(facts, dtype=np.int64).reshape(-1, 5)
                rows = np.repeat(table[:, :4], table[:, 4], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)]], names=["key", "sid", "n", "g", "need"])

        return texts.select("text").mapInArrow(run, "key long, sid long, n long, g long, need long")

    # pieces that at least two different sets have
    several = lambda df: df.groupBy("key").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x <> y").select("key")
    shared = materialize(several(keys_of()))
    bitmap = docs.sparkSession.sparkContext.broadcast(_prefilter(shared, "key"))
    members = materialize(keys_of(bitmap).distinct().join(shared, "key"))
    bitmap.destroy()
    for _ in range(2):
        enough = members.groupBy("sid", "g", "need").agg(F.count(F.lit(1)).alias("c")).where("c >= need").select("sid", "g")
        fewer = _instead(members, members.join(enough, ["sid", "g"], "left_semi"))
        members = _instead(fewer, fewer.join(several(fewer), "key", "left_semi"))
    parts = _parts(members.select(F.col("sid").alias("set_id")).distinct(), texts, n, seed)
    # shingles of one candidate only can't be matched
    alone = parts.select("sid", F.explode("part").alias("s")).groupBy("s").agg(F.min("sid").alias("sid"), F.count(F.lit(1)).alias("c")).where("c = 1").groupBy("sid").agg(F.count(F.lit(1)).alias("u"))
    wide = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    weight = members.join(wide, "key").groupBy("sid").agg(F.sum("c").alias("weight"))
    facts = weight.join(alone, "sid", "left").select("sid", "weight", F.coalesce("u", F.lit(0)).alias("u"))
    members = _instead(members, members.join(facts, "sid").withColumn("m", F.col("n") - F.col("u")).drop("u"))
    can = f"100 * least(a.m, b.m) >= {percent} * (a.n + b.n - least(a.m, b.m))"
    middle = members.groupBy("key").agg(F.max(F.struct("weight", "sid", "n", "m")).alias("b")).select("key", "b.sid", "b.n", "b.m")
    stars = members.alias("a").join(middle.alias("b"), F.expr("a.key = b.key and a.sid <> b.sid and " + can)).select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct()
    stars = materialize(stars)
    links = materialize(_verified(stars, parts, percent))
    found = components(links)
    members = _instead(members, members.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid")))
    # pieces of more than one component: pairs of sets between them that can be similar
    open_keys = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    few, many = _rarest(members.where(f"100 * m >= {percent} * n").join(open_keys, "key"))
    room = "least(a.pieces - a.i, b.pieces - b.i) + 1 >= greatest(a.need, b.need)"
    pairs = few.alias("a").join(few.alias("b"), F.expr(f"a.key = b.key and a.component <> b.component and a.sid < b.sid and {room} and {can}")).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b"))
    described = None
    if not many.isEmpty():
        described, across = _across_groups(many, parts, percent)
        pairs = pairs.unionByName(across)
    more = materialize(pairs.distinct().join(stars, ["a", "b"], "left_anti"))
    extra = materialize(_verified(more, parts, percent))
    if not extra.isEmpty():
        links = _instead(links, links.unionByName(extra))
        discard(found)
        found = components(links)
    out = materialize(_labelled(base, links, found, id_col))
    for used in (base, shared, members, parts, stars, few, many, described, more, extra, links, found):
        if used is not None:
            discard(used)
    return out


def _instead(old: DataFrame, new: DataFrame) -> DataFrame:
    """A table of `new`, which reads `old`; `old` is deleted."""
    new = materialize(new)
    discard(old)
    return new


def _rarest(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of pieces that up to SMALL sets list, and those of the other pieces.

    A set that must share `need` of its pieces lists all but need - 1 of them, the rarest first: two similar sets
    list a common piece. i is the place of a piece in the list.
    """
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    whole = Window.partitionBy("sid", "g")
    placed = left.join(sizes, "key").withColumns({"i": F.row_number().over(whole.orderBy("w", "key")), "pieces": F.count(F.lit(1)).over(whole)})
    listed = materialize(placed.where("i <= pieces - need + 1").drop("w"))
    again = listed.groupBy("key").agg(F.count(F.lit(1)).alias("w"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key", "w")
    few = materialize(listed.join(again.where(F.col("w") <= SMALL), "key").drop("w"))
    many = materialize(listed.join(again.where(F.col("w") > SMALL), "key").drop("w"))
    discard(listed)
    return few, many


def _across_groups(many: DataFrame, parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table of descriptions, and pairs (a, b) that can be similar of sets that list a piece of a large group and are not connected.

    Each piece takes the component of that set with most in common with all others, and all pieces that take one
    component have one centre in it. Each of their sets is described by what it and the centre don't both have. The
    symmetric difference of two sets is that of their descriptions. Sets that may be similar to the centre itself are
    compared to it, so of two others that are similar and not connected through it, one has a description longer than
    the difference of similar sets: the descriptions have something in common. Of a description, as many of the
    rarest shingles are listed as similar sets may differ in, and one more; places in the lists bound what two
    descriptions can share. One of the two sets is outside the centre's component, so the many inside only meet those.
    """
    middle = many.groupBy("key").agg(F.max(F.struct("weight", "sid", "component")).alias("b")).select("key", F.col("b.component").alias("home"))
    heads = many.groupBy("component").agg(F.max(F.struct("weight", "sid")).alias("h")).select(F.col("component").alias("home"), F.col("h.sid").alias("c"))
    near = many.join(middle, "key").groupBy("home", "sid").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.first("m").alias("m")).join(heads, "home").where("sid <> c")
    spread = near.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))))
    none = F.array().cast("array<long>")
    p, q = F.coalesce("p", none), F.coalesce("q", none)
    own = spread.join(parts.select("sid", "fragment", F.col("part").alias("p")), ["sid", "fragment"], "left")
    both = own.join(parts.select(F.col("sid").alias("c"), "fragment", F.col("part").alias("q")), ["c", "fragment"], "left")
    facts = ["c", "home", "sid", "component", "n", "m"]
    described = materialize(both.select(*facts, F.explode(F.concat(F.array_except(p, q), F.array_except(q, p))).alias("s")))
    often = described.groupBy("c", "s").agg(F.count(F.lit(1)).alias("w"), (F.min("component") < F.max("component")).alias("open"))
    whole = Window.partitionBy("c", "sid")
    placed = described.join(often, ["c", "s"]).withColumns({"i": F.row_number().over(whole.orderBy("w", "s")), "size": F.count(F.lit(1)).over(whole)})
    listed = placed.where(f"open and i <= ({100 - percent} * n) div {percent} + 1")
    differ = f"{100 + percent} * (a.size + b.size - 2 * (least(a.size - a.i, b.size - b.i) + 1)) <= {100 - percent} * (a.n + b.n)"
    can = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and 100 * least(a.m, b.m) >= {percent} * (a.n + b.n - least(a.m, b.m))"
    outside = listed.where("component <> home").alias("a")
    once = "a.component <> b.component and (b.component = b.home or a.sid < b.sid)"
    meet = outside.join(listed.alias("b"), F.expr(f"a.c = b.c and a.s = b.s and {once} and {can} and {differ}"))
    with_centre = near.where("component <> home").select(F.least("sid", "c").alias("a"), F.greatest("sid", "c").alias("b"))
    return described, meet.select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).unionByName(with_centre)


def _labelled(base: DataFrame, links: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    first = base.where("n > 0").groupBy("set_id").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    named = first.join(found, first["set_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "set_id"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_rows"))
    named = named.join(roots, "component").join(ends, "node", "left").where("group_rows > 1")
    named = named.select(F.col("set_id").alias("_set"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = base.join(named, (F.col("set_id") == F.col("_set")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "set_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def _parts(wanted: DataFrame, texts: DataFrame, n: int, seed: int) -> DataFrame:
    """(sid, fragment, n, part): the shingles of the wanted sets in each fragment, once for each set."""
    wanted = materialize(wanted)
    bitmap = texts.sparkSession.sparkContext.broadcast(_prefilter(wanted, "set_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, s in _sets(batch, n):
                sid = np.array([identity(s, seed)], dtype=np.int64)
                if len(s) and _passes(bitmap.value, sid.view(np.uint64))[0]:
                    cut = np.searchsorted(s >> np.uint64(61), np.arange(1, FRAGMENTS, dtype=np.uint64))
                    rows += [(int(sid[0]), f, len(s), part.view(np.int64)) for f, part in enumerate(np.split(s, cut)) if len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["sid", "fragment", "n", "part"],
            )

    parts = texts.select("text").mapInArrow(run, "sid long, fragment int, n long, part array<long>").join(wanted.withColumnRenamed("set_id", "sid"), "sid", "left_semi")
    found = _instead(wanted, parts.dropDuplicates(["sid", "fragment"]))
    bitmap.destroy()
    return found


def _verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set identifiers whose sets are similar, with their overlap."""
    left = parts.select(F.col("sid").alias("a"), "fragment", F.col("n").alias("na"), F.col("part").alias("p"))
    right = parts.select(F.col("sid").alias("b"), "fragment", F.col("n").alias("nb"), F.col("part").alias("q"))
    counted = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("p", "q")).alias("c"))
    overlaps = counted.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("overlap"))
    return overlaps.where(f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b", "overlap")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component, that with the smallest id, and all rows without words; the columns of docs.

    All columns of docs stay, whatever their names. Rows equal in id and text become one. Rows that repeat an id with other texts stay if one of them does. Rows with
    a null id stay only where no row of their component has an id.
    """
    found = near_duplicates(docs, id_col, text_col, n, percent)
    stays = F.expr(f"n_shingles = 0 or `{id_col}` <=> component_id")
    verdict = found.groupBy(F.col(id_col).alias("_id")).agg(F.max(stays).alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    verdict = _instead(found, verdict.where("not _kept or _rows > 1").drop("_rows"))
    return kept_rows(docs, verdict, id_col, F.col(text_col))
