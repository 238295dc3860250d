"""The audit of filters, the trie of conversations and the lines of many documents, against plain versions."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigwarn.llm import filter_audit, line_dedup, prefix_trie

CLASH = ("_id", "_text", "_same", "_n", "part", "mask", "n", "good", "key", "id", "version", "places", "_keep", "_slot", "n_lines", "kept", "path", "depth", "t", "e", "step")
SHARED = "One line that more than a few documents hold"


def wide(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


# -- op11 ---------------------------------------------------------------------------------------------------------------


def audit_rows():
    words = " ".join(f"w{k}" for k in range(220))
    texts = [words, words, "ab " * 250, None, "", words.upper(), words + " $", "x" * 90_000, words, "a\xa0b " + words]
    rows = [(k, f"s{k % 2}" if k else None, t) for k, t in enumerate(texts)]
    return rows + [rows[1], (None, "s1", words), (None, "s1", words), (9, "s0", "")]


def plain_audit(rows, labels):
    def words(t):
        return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]

    failing = []
    for k, part, text in rows:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = k is not None and any(j is not None and j < k and (u or "") == t for j, _, u in rows)
        failing.append((part or "", {x for x in fails if fails[x]}, labels.get(k, (0, 0))))
    out, shapley = {}, {}
    for part in {p for p, _, _ in failing}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, n = order[step - 1], [0] * 6
                for p, fails, (good, toxic) in failing:
                    if p == part:
                        before = bool(fails & set(order[: step - 1]))
                        removed = letter in fails and not before
                        n = [a + b for a, b in zip(n, (not fails & set(order[:step]), removed, letter in fails and before, fails == {letter}, removed and good == 1, removed and toxic == 1), strict=True)]
                out[part, order, step] = n
                shapley[part, letter] = shapley.get((part, letter), 0) + n[1]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark):
    rows, labels = audit_rows(), {1: (1, 0), 2: (0, 1), 3: (1, 1), 8: (1, 0), 77: (1, 1)}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    marks = [(k, *v) for k, v in labels.items()] + [(1, 0, None), (None, 1, 1), (2, None, 0)]
    found = filter_audit.audit(wide(docs).repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert {tuple(r) for r in found.collect()} == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    some = spark.createDataFrame([(1, None, None)], docs.schema)
    assert filter_audit.audit(some, labels).count() == 600


# -- op12 ---------------------------------------------------------------------------------------------------------------


def brute_trie(paths):
    """paths: {conv_id: tuple of (element, size)}."""
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * p[-1][1] if p else 0
        leaves[p] = 1 if p not in children else sum(leaves[x] for x in children[p])
        saved[p] = own + sum(saved[x] for x in children.get(p, []))
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if paths[c] == p).encode()).hexdigest()
    return sorted((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else -1, len(nodes[p]), len(children.get(p, [])), leaves[p], saved[p], ends(p)) for p in nodes)


def found_trie(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("block", [1, prefix_trie.BLOCK_TURNS])
def test_trie_of_random_paths(spark, block, monkeypatch):
    rng = random.Random(block)
    paths = {}
    for c in range(300):
        start = rng.choice(list(paths.values())) if paths and rng.random() < 0.7 else ()
        paths[c * 7] = start[: rng.randint(0, len(start))] + tuple((x := rng.randint(0, 2), x * 5) for _ in range(rng.randint(0, 6)))
    paths[1], paths[2] = tuple((3, 15) for _ in range(400)), tuple((3, 15) for _ in range(399)) + ((1, 5),)
    coded = [(c, [bytes([x]) * 16 + size.to_bytes(8, "big") for x, size in p]) for c, p in paths.items()]
    df = spark.createDataFrame(coded, "conv_id long, elements array<binary>").repartition(4)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    assert found_trie(prefix_trie.trie_of(df)) == brute_trie(paths)


@pytest.mark.parametrize("seed", range(6))
def test_parentheses_find_their_partners(seed):
    rng, opens, stack, partner = np.random.default_rng(seed), [True], [0], {}
    while stack:
        if len(opens) < 4000 and (len(stack) == 1 or rng.random() < (0.5, 0.8, 0.2)[seed % 3]):
            stack.append(len(opens))
            opens.append(True)
        else:
            partner[stack.pop()] = len(opens)
            opens.append(False)
    tree = prefix_trie.Parentheses(np.array(opens))
    at = np.array(sorted(partner))
    assert tree.close_of(at).tolist() == [partner[k] for k in at.tolist()]
    assert tree.pairs[-1] == sum(a and not b for a, b in zip(opens, opens[1:], strict=False))


def test_odd_conversations(spark):
    long = "word " * 40_000
    rows = [(1, 0, "user", "a"), (1, None, None, None), (1, 2, "user", long), (2, 0, None, ""), (2, 1, "user", "a"), (2, 2, "user", long), (3, 5, "a", "b"), (3, 5, "a", "b"), (None, 0, "user", "a"), (-4, 0, "", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    blank, a = (("", ""), 0), (("user", "a"), 1)
    paths = {1: (blank, a, (("user", long), len(long))), 2: (blank, a, (("user", long), len(long))), 3: ((("a", "b"), 1),) * 2, -4: (blank,)}
    assert found_trie(prefix_trie.prefix_trie(wide(turns))) == brute_trie(paths)
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0


def test_borrowed_heads(spark):
    own = {c: tuple((f"{c}.{k}", 1) for k in range(c % 11)) for c in [*range(0, 40), 57, 58, -3, -5, 103]}
    del own[10]
    rows = spark.createDataFrame([(c, [f"{x}".encode() for x, _ in p]) for c, p in own.items()], "conv_id long, elements array<binary>")
    got = {r["conv_id"]: [bytes(x).decode() for x in r["elements"]] for r in prefix_trie.with_borrowed_heads(rows).collect()}
    for c, p in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), ())
        assert got[c] == [x for x, _ in base[:h] + p[h:]]


# -- op13 ---------------------------------------------------------------------------------------------------------------


def plain_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders, rank = {}, lambda k: (k is not None, k if k is not None else 0)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or k == max(holders[key(x)], key=rank)]
        out.append((str(k), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def line_rows():
    accents, short = "Élan ÉLAN élan abcdefghijk", "é" * 19
    texts = [None, "", f"{SHARED}\nown line\n{SHARED}", f"  {SHARED.upper()}\t\nrest", f"{SHARED}\r", f"{SHARED}\n{SHARED}\n", f"{accents}\n{short}", f"{accents.lower()}\n{short}", f"{accents}\n{short}\n", f"{accents}\n{short}", "\n\n\n", (f"{SHARED}\n" + "z" * 60_000 + "\n") * 3, "only " + SHARED]
    rows = list(enumerate(texts))
    return rows + [rows[2], rows[11], (11, f"{SHARED}\nother text of the same id"), (None, f"x\n{SHARED}"), (None, SHARED)]


@pytest.mark.parametrize(("parts", "pending"), [(1, 5), (6, 5), (3, line_dedup.PENDING)])
def test_lines_of_odd_rows(spark, parts, pending, monkeypatch):
    monkeypatch.setattr(line_dedup, "PENDING", pending)
    rows = line_rows()
    docs = wide(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    bitmaps = line_dedup.line_bitmaps(docs)
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    assert kept.columns == docs.columns
    want = plain_lines(rows)
    found = kept.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in found) == sorted((k, t) for k, _, _, t in want)
    assert all(r["key"] == "own key" for r in found) and sum(r["text"] is None for r in found) == 1
    digests = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digests(docs, bitmaps).collect())
    assert digests == sorted((k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in want)


def test_random_lines(spark):
    rng = random.Random(5)
    pool = [f"line number {k} of the pool, {'A' if k % 2 else 'a'} long one" for k in range(60)]
    rows = [(k, "\n".join(rng.choice([pool[0], rng.choice(pool), rng.choice(pool).upper(), f"own line {k} {rng.random()}"]) for _ in range(rng.randint(0, 12)))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect())
    assert found == [(k, t) for k, _, _, t in plain_lines(rows)]


def test_lines_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    bitmaps = line_dedup.line_bitmaps(docs)
    assert bitmaps.count() == 0 and line_dedup.apply_bitmaps(docs, bitmaps).count() == 0


def test_bitmaps_come_back():
    keep = np.array([True, False, True] * 700)
    packed = line_dedup.pack_bits(keep)
    assert len(packed) < 60 and (line_dedup.unpack_bits(packed, len(keep)) == keep).all()
