"""The trie of conversations by their first turns: who shares which beginning, and what sharing it saves.

A turn becomes an element of ELEMENT bytes: 16 of its role's and text's digest and 8 of the text's size. A conversation is
the string of its elements, its path. Paths in order are dealt out by ranges; each task builds the trie of its range as
balanced parentheses, and only the spines at both ends of a range, which neighbours share, are merged afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwarn.llm.store import materialize

ELEMENT = 24
#: Ranges are cut between paths that differ in their first SPINE turns, so no node deeper than that lies in two ranges.
SPINE = 32
#: Turns from which on a task starts the next trie of its range.
BLOCK_TURNS = 200_000
#: Ids of copies are brought together by the number that is left of them without so many bits: at most 2 ** ID_BITS ids a row.
ID_BITS = 10
#: Positions of a block of the range min-max tree.
PARENS = 64
NOTHING = hashlib.sha256(b"").hexdigest()


def element(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return F.unhex(F.concat(F.substring(F.sha2(said, 256), 1, 2 * (ELEMENT - 8)), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")))


def elements(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, elements) of each conversation, in order of turns, null first, ties by digest; rows without a conversation are left out."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("t"), element(F.col(role_col), F.col(text_col)).alias("e"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("t", "e"))).alias("s")).select("conv_id", F.transform("s", lambda x: x["e"]).alias("elements"))


def with_borrowed_heads(convs: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """convs(conv_id, elements), the first h = crc32(conv_id) % longest elements of c replaced by those of conversation c - c % family."""
    base = F.col("conv_id") - F.col("conv_id") % family
    families = convs.groupBy(base.alias("b")).agg(F.collect_list(F.struct("conv_id", "elements")).alias("f"))  # at most 2 * family - 1
    head = F.coalesce(F.try_element_at(F.filter("f", lambda x: x["conv_id"] == F.col("b")), F.lit(1))["elements"], F.array().cast("array<binary>"))

    def rebuilt(x: Column) -> Column:
        h = (F.crc32(x["conv_id"].cast("string").cast("binary")) % longest).cast("int")
        return F.struct(x["conv_id"].alias("conv_id"), F.concat(F.slice(head, F.lit(1), h), F.slice(x["elements"], h + 1, F.size(x["elements"]))).alias("elements"))

    return families.select(F.inline(F.transform("f", rebuilt)))


class Parentheses:
    """A tree as parentheses in preorder, with the least excess of every block and a tree of minima over the blocks."""

    def __init__(self, opens: np.ndarray) -> None:
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-len(opens) // PARENS)
        self.leaves = 1 << max(0, int(blocks - 1).bit_length())
        high = np.iinfo(np.int64).max
        padded = np.full(blocks * PARENS, high)
        padded[: len(opens)] = self.excess
        self.low = np.full(2 * self.leaves, high)
        self.low[self.leaves : self.leaves + blocks] = padded.reshape(blocks, PARENS).min(axis=1)
        width = self.leaves
        while width > 1:
            width //= 2
            self.low[width : 2 * width] = self.low[2 * width : 4 * width].reshape(width, 2).min(axis=1)
        pair = np.zeros(len(opens) + 1, dtype=np.int64)
        np.cumsum(opens[:-1] & ~opens[1:], out=pair[1:-1])
        pair[-1] = pair[-2]
        #: Leaf pairs "()" that begin before a position.
        self.pairs = pair

    def close_of(self, at: np.ndarray) -> np.ndarray:
        """The closing position of every opening one: the first later position whose excess is below that of `at`."""
        want, out = self.excess[at] - 1, np.full(len(at), -1, dtype=np.int64)
        left = self._scan(np.arange(len(at)), at + 1, want, out)
        if not len(left):
            return out
        node, goal = self.leaves + at[left] // PARENS + 1, want[left]
        todo = np.arange(len(left))
        while len(todo):
            here, fits = node[todo], self.low[node[todo]] <= goal[todo]
            done = fits & (here >= self.leaves)
            onward = here + 1
            node[todo] = np.where(done, here, np.where(fits, 2 * here, np.where(onward % 2 == 0, onward // 2, onward)))
            todo = todo[~done]
        self._scan(left, (node - self.leaves) * PARENS, want, out)
        return out

    def _scan(self, which: np.ndarray, start: np.ndarray, want: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Looks from `start` to the end of its block; returns those of `which` that found nothing."""
        end = np.minimum((start // PARENS + 1) * PARENS, len(self.excess))
        while len(which):
            inside = start < end
            hit = np.zeros(len(which), dtype=bool)
            hit[inside] = self.excess[start[inside]] <= want[which[inside]]
            out[which[hit]] = start[hit]
            if not inside.any():
                break
            rest = ~hit
            which, start, end = which[rest], start[rest] + 1, end[rest]
            if len(which) and not (start < end).any():
                break
        return which


def common_turns(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many first elements each path shares with the one before; 0 for the first."""
    length = np.diff(offsets)
    least = np.minimum(length[1:], length[:-1])
    path = np.repeat(np.arange(len(least)), least)
    place = np.arange(len(path)) - np.repeat(np.cumsum(least) - least, least)
    unequal = np.flatnonzero((flat[offsets[:-2][path] + place] != flat[offsets[1:-1][path] + place]).any(axis=1))
    found, first = np.unique(path[unequal], return_index=True)
    out = np.concatenate([[0], least])
    out[found + 1] = place[unequal[first]]
    return out


def trie(paths: list[bytes], n: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The nodes of distinct sorted paths in preorder, the root first; n conversations end at each path, `first` the smallest.

    depth, parent, size (of the last text), end (path that ends there or -1), conv_id, n_convs, n_children, n_leaves, saved.
    """
    length = np.array([len(p) // ELEMENT for p in paths], dtype=np.int64)
    flat = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, ELEMENT // 8)
    offsets = np.concatenate([[0], np.cumsum(length)])
    shared = common_turns(flat, offsets)
    new = length - shared
    start = 1 + np.cumsum(new) - new
    path = np.repeat(np.arange(len(paths)), new)
    nodes = 1 + len(path)
    depth = np.zeros(nodes, dtype=np.int64)
    depth[1:] = np.arange(nodes - 1) - np.repeat(start - 1, new) + shared[path] + 1
    size = np.zeros(nodes, dtype=np.int64)
    size[1:] = flat[offsets[path] + depth[1:] - 1, -1].astype(np.int64)
    end = np.full(nodes, -1, dtype=np.int64)
    end[np.where(length > 0, start + new - 1, 0)] = np.arange(len(paths))

    closed = np.concatenate([[0], length[:-1] - shared[1:], length[-1:]])
    runs = np.stack([closed, np.append(new, 0)], axis=1).ravel()
    inner = np.repeat(np.arange(len(runs)) % 2 == 1, runs)
    tree = Parentheses(np.concatenate([[True], inner, [False]]))
    opened = np.flatnonzero(tree.opens)
    closes = tree.close_of(opened)
    behind = np.arange(nodes) + (closes - opened + 1) // 2

    order = depth * nodes + np.arange(nodes)
    ranked = np.sort(order)
    parent = np.full(nodes, -1, dtype=np.int64)
    parent[1:] = ranked[np.searchsorted(ranked, order[1:] - nodes) - 1] % nodes
    ended = np.concatenate([[0], np.cumsum(end >= 0)])
    by_path = np.concatenate([[0], np.cumsum(n)])
    n_convs = by_path[ended[behind]] - by_path[ended[:-1]]
    own = np.concatenate([[0], np.cumsum((n_convs - 1) * size)])
    smallest = np.minimum.reduceat(np.append(first, np.iinfo(np.int64).max), np.stack([ended[:-1], ended[behind]], axis=1).ravel())[::2]
    return {
        "depth": depth, "parent": parent, "size": size, "end": end, "conv_id": smallest, "n_convs": n_convs,
        "n_children": np.bincount(parent[1:], minlength=nodes), "n_leaves": tree.pairs[closes + 1] - tree.pairs[opened], "saved": own[behind] - own[:-1],
    }


SCHEMA = "shared boolean, path binary, parent_path binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, size long, ends string"


def _rows(paths: list[bytes], n: list[int], first: list[int], ends: list[str]) -> pa.RecordBatch:
    """SCHEMA: the nodes of a range's trie. Of nodes on its spines, what lies outside the spines: the sums of other children."""
    t = trie(paths, np.array(n, dtype=np.int64), np.array(first, dtype=np.int64))
    depth, parent = t["depth"], t["parent"]
    spine, key_of = np.zeros(len(depth), dtype=bool), {}
    last = int(np.flatnonzero(t["end"] == len(paths) - 1)[0])
    for path, node in ((paths[0], len(paths[0]) // ELEMENT), (paths[-1], last)):
        while node >= 0:
            if depth[node] <= SPINE:
                spine[node] = True
                key_of[node] = path[: ELEMENT * int(depth[node])]
            node = int(parent[node])
    below = np.flatnonzero(~spine & (parent >= 0) & spine[parent])
    for c in ("n_leaves", "saved", "n_children"):
        outside = np.zeros(len(depth), dtype=np.int64)
        np.add.at(outside, parent[below], t[c][below] if c != "n_children" else 1)
        t[c] = np.where(spine, outside, t[c])
    at = np.array(sorted(key_of), dtype=np.int64)
    keys, place = pa.array([key_of[k] for k in at.tolist()], pa.binary()), np.searchsorted(at, np.arange(len(depth)))
    on_spine = lambda node, yes: keys.take(pa.array(np.where(yes, place[node], 0), mask=~yes))
    under = np.zeros(len(depth), dtype=bool)
    under[below] = True
    ends_of = pa.array(ends, pa.string()).take(pa.array(np.maximum(t["end"], 0), mask=t["end"] < 0))
    own_parent = pa.array(t["conv_id"][np.maximum(parent, 0)], mask=spine | under)
    columns = [pa.array(spine), on_spine(np.arange(len(depth)), spine), on_spine(np.maximum(parent, 0), under), pa.array(depth), pa.array(t["conv_id"]), own_parent]
    columns += [pa.array(t[c]) for c in ("n_convs", "n_children", "n_leaves", "saved", "size")]
    return pa.RecordBatch.from_arrays([*columns, ends_of], [c.split()[0] for c in SCHEMA.split(", ")])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of one range: rows (path, n, first, ids) in order, those of one path joined, cut where first turns differ."""
    paths, n, first, ends, digest, turns = [], [], [], [], None, 0
    for batch in batches:
        for path, count, smallest, ids in zip(*[batch.column(c).to_pylist() for c in ("path", "n", "first", "ids")], strict=True):
            if paths and path == paths[-1]:
                n[-1] += count
                first[-1] = min(first[-1], smallest)
                digest.update(b"," + ids.encode())
                continue
            if paths:
                ends.append(digest.hexdigest())
            if turns >= BLOCK_TURNS and path[: SPINE * ELEMENT] != paths[-1][: SPINE * ELEMENT]:
                yield _rows(paths, n, first, ends)
                paths, n, first, ends, turns = [], [], [], [], 0
            digest = hashlib.sha256(ids.encode())
            paths.append(path)
            n.append(count)
            first.append(smallest)
            turns += len(path) // ELEMENT
    if paths:
        yield _rows(paths, n, first, [*ends, digest.hexdigest()])


def _merged(spines: DataFrame) -> DataFrame:
    """(path, depth, conv_id, n_convs, n_children, n_leaves, saved, ends) of the nodes that ranges share, each once and whole."""
    sums = spines.groupBy("path").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")], F.max("size").alias("size"), F.max("ends").alias("ends"))
    sums = materialize(sums)
    above = lambda c, steps: F.substr(c, F.lit(1), (F.length(c) - steps * ELEMENT).cast("int"))
    children = sums.where("depth > 0").groupBy(above(F.col("path"), F.lit(1)).alias("path")).agg(F.count(F.lit(1)).alias("_more"))
    whole = sums.join(children, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    own = whole.select("path", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("s"), F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("up"))
    under = own.groupBy(above(F.col("path"), F.col("up")).alias("path")).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved"))
    return materialize(whole.drop("n_leaves", "saved", "size", "_more").join(under, "path").withColumn("parent_path", F.when(F.col("depth") > 0, above(F.col("path"), F.lit(1)))))


def trie_of(convs: DataFrame) -> DataFrame:
    """The nodes of convs(conv_id, elements): see prefix_trie()."""
    path = F.unhex(F.array_join(F.transform("elements", lambda e: F.hex(e)), ""))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    grouped = convs.select("conv_id", path.alias("path")).groupBy("path", F.shiftright("conv_id", ID_BITS).alias("part"))
    grouped = grouped.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))
    dealt = grouped.repartitionByRange(F.substring("path", 1, SPINE * ELEMENT)).sortWithinPartitions("path", "part")
    nodes = materialize(dealt.select("path", "n", "first", "ids").mapInArrow(_tries, SCHEMA))
    merged = _merged(nodes.where("shared"))
    known = F.broadcast(merged.select(F.col("path").alias("_path"), F.col("conv_id").alias("_conv")))  # at most 2 * (SPINE + 1) rows a range
    inner = nodes.where("not shared").select("depth", "conv_id", "parent_path", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    spine = merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*inner.columns)
    met = inner.unionByName(spine).join(known, F.col("parent_path") == F.col("_path"), "left")
    return met.select("conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct sequence of first turns, the empty one (the root) too: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest conversation that begins so, parent_conv_id its parent's (null at the root), n_convs their number.
    n_leaves counts childless nodes of the subtree, saved_tokens sums over it (n_convs - 1) times the bytes of the
    node's last text. ends_sha256 is of the ids that end here, ascending, joined by commas.

    Ids are whole numbers. Null roles and texts count as empty; null turn numbers come first, turns with the same number
    are ordered by their digests, repeated rows are turns each. Rows with a null id are left out. An empty table has no
    nodes; other columns are not looked at. A conversation's elements must fit one task; conversations that share SPINE turns
    are worked on together, copies of one another as one.
    """
    return trie_of(elements(turns, conv_col, turn_col, role_col, text_col))
