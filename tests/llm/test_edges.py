"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigwarn.llm import bpe, chat, exact_dedup, jaccard, licenses, maxent_lm, packing, pii, quality, topk

#: An extra column of every name that operators use inside or return.
CLASH = ("_own", "_slot", "_taken", "_id", "_row", "_kept", "_same", "_n", "id", "text_", "n", "c", "kept", "keep_id", "score", "n_tokens", "bucket", "component_id", "spans", "held_out")
LONG = "word and other words, number 7. " * 4000
TEXTS = [None, "", " \t\n", "a", "a", LONG, LONG, "mail a.b@example.org or +44 20 7946 0958 now", LONG + "tail", "x" * 50_000]


def frame(spark, ids=None, extra=True):
    rows = [(i if ids is None else ids[k], t, None) for k, (i, t) in enumerate(zip(range(len(TEXTS)), TEXTS, strict=True))]
    rows += [rows[3], rows[5], (None, "no id", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}) if extra else df


def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(len(TEXTS))], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda s, d: exact_dedup.exact_duplicates(d),
    "quality": lambda s, d: quality.score(d, quality.fit(d, labels(s))),
    "lm": lambda s, d: maxent_lm.score(d),
    "packing": lambda s, d: packing.pack(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "jaccard": lambda s, d: jaccard.near_duplicates(d),
    "pii": lambda s, d: pii.find_personal_data(d),
}
DROPPING = {
    "exact": lambda s, d: exact_dedup.drop_exact_duplicates(d),
    "near": lambda s, d: jaccard.drop_near_duplicates(d),
    "good": lambda s, d: quality.keep_good(d, labels(s)),
    "redact": lambda s, d: pii.redact(d, chars_col="n_chars"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row_whatever_is_in_it(spark, name):
    df = frame(spark)
    got = OPERATORS[name](spark, df).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in df.collect())
    assert OPERATORS[name](spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("name", DROPPING)
def test_columns_of_any_name_stay(spark, name):
    df = frame(spark)
    got = DROPPING[name](spark, df)
    assert got.columns == df.columns
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    assert DROPPING[name](spark, df.limit(0)).count() == 0
    if name == "exact":
        assert sorted((r["doc_id"] is None, r["text"] or "") for r in rows) == sorted({("no id" == t, t or "") for t in [*TEXTS, "no id"]})
        assert {r["doc_id"] for r in rows if (r["text"] or "") == ""} == {1} and {r["doc_id"] for r in rows if r["text"] == "a"} == {4}
    if name == "near":
        assert {r["doc_id"] for r in rows if r["text"] and r["text"].startswith(LONG)} == {5} and {r["doc_id"] for r in rows if r["text"] == "a"} == {3}
        assert sum(not (r["text"] or "").strip() for r in rows) == 4


def test_ids_may_be_texts(spark):
    df = frame(spark, ids=list(range(10))).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()}
    assert found["d8"] == found["d5"] == "d5" and found["d4"] == "d3"
    assert {r["doc_id"] for r in jaccard.drop_near_duplicates(df).where("text like 'word%'").collect()} == {"d5"}
    assert packing.pack(df).count() == 14


def encoded(d, id_col):
    import public_tokenizers

    return bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, id_col=id_col)


NAMED = {
    "kept": lambda s, d: exact_dedup.exact_duplicates(d, id_col="kept"),
    "Score": lambda s, d: quality.score(d, quality.fit(d.withColumnRenamed("Score", "doc_id"), labels(s)), id_col="Score"),
    "n_known": lambda s, d: maxent_lm.score(d, id_col="n_known"),
    "n_tokens": lambda s, d: encoded(d, "n_tokens"),
    "bucket": lambda s, d: packing.pack(d, id_col="bucket"),
    "n_sentences": lambda s, d: licenses.scan_licenses(d, id_col="n_sentences"),
    "n_links": lambda s, d: jaccard.near_duplicates(d, id_col="n_links"),
    "spans": lambda s, d: pii.find_personal_data(d, id_col="spans"),
    "n_turns": lambda s, d: chat.format_chats(d.withColumns({"turn": F.lit(0), "role": F.lit("user"), "parts": chat.text_part(F.col("text"))}), conv_col="n_turns"),
}


@pytest.mark.parametrize("name", NAMED)
def test_an_id_named_like_a_result(spark, name):
    df = spark.createDataFrame([(3, "a b"), (4, None), (5, "a b")], f"{name} long, text string")
    out = NAMED[name](spark, df)
    assert {c.lower() for c in out.columns} >= {name.lower(), name.lower() + "_"} and len({c.lower() for c in out.columns}) == len(out.columns)
    assert sorted(r[name] for r in out.collect()) == [3, 4, 5]


def test_vectors_of_any_size(spark):
    rows = [(0, [1e9, 1.0]), (20, [1e9, -2.0]), (1, [5.0, 5.0]), (2, [1e17, 0.0]), (3, [float("inf"), 0.0]), (4, None), (5, [None, 1.0]), (None, [1.0, 1.0]), (1, [5.0, 5.0])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = {k: [int(np.floor(64 * x)) for x in v] for k, v in ((0, [1e9, 1.0]), (20, [1e9, -2.0]), (1, [5.0, 5.0]), (2, [1e17, 0.0]))}
    most = 2**63 - 1
    assert got == {(q, x): min(most, sum(a * b for a, b in zip(whole[q], whole[x], strict=True))) for q in (0, 20) for x in whole if q != x}


def test_typed_parts_come_back(spark):
    content = '[{"type":"text","text":"see <image 0> \\\\ "},{"type":"image","ref":"a.png","tokens":5},{"type":"audio","ref":"b.wav"},{"type":"text","text":"<end"},null]'
    turns = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None), (1, 2, "user", '[{"type":"document","ref":"c"}]')], "conv_id long, turn int, role string, text string")
    chats = chat.read_back(chat.format_chats(turns.withColumn("parts", chat.parts_of_json(F.col("text")))))
    row = chats.select("attachments", F.transform("turns", lambda t: chat.read_parts(t["raw"])).alias("p")).first()
    assert [(a["k"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, 0, "image", "a.png", 5), (1, 0, "audio", "b.wav", 0), (2, 2, "document", "c", 0)]
    assert [[tuple(p) for p in turn] for turn in row["p"]] == [[("text", "see <image 0> \\ ", None), ("image", None, 0), ("audio", None, 1), ("text", "<end", None)], [], [("document", None, 2)]]


def test_encoding_of_any_text(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = frame(spark)
    got = bpe.encode(df, path, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())
    assert bpe.encode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version over the rows that its predecessor kept."""
    good = [f"The committee met on day {k} and agreed on item number {k * 7} after a long and careful talk about costs, plans and people." for k in range(40)]
    texts = good + [good[3], good[4], good[5] + " Yes."] + ["zz !!! 000 " * 12] * 5 + [f"write to person{k}@example.org about it {k}" for k in range(3)] + [None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int("zz" not in (t or "")), 0) for k, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
        assert name == "packing" or docs.columns == columns
    kept, exact, near, clean, packed = seen
    scores = {r["doc_id"]: r["score"] for r in quality.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert set(kept) == {k for k, s in scores.items() if s >= 0.3} and set(range(40)) <= set(kept)
    last = {}
    for k in sorted(kept):
        last[texts[k] or ""] = k
    assert set(exact) == set(last.values())
    sets = {k: ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (texts[k] or "").lower().split()) else set()) for k in exact}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert set(near) == {k for k in sets if not sets[k] or root[k] == k} and 42 not in near
    assert set(clean) == set(near) and all("@" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in clean.values() if r["text"] is not None)
    assert all(clean[k]["text"] == texts[k] for k in clean if k < 40)
    assert {k: r["n_tokens"] for k, r in packed.items()} == {k: len((r["text"] or "").split()) for k, r in clean.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed.values()))


def planted(seed, n):
    """(text, start, end or None): personal data of many forms in sentences, and look-alikes that are none."""
    import random

    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    token = lambda k, of="ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz0123456789": "".join(rng.choice(of) for _ in range(k))

    def iban():
        bank = digits(18)
        check = 98 - int(bank + "131400") % 97
        whole = f"DE{check:02d}{bank}"
        return " ".join(whole[k : k + 4] for k in range(0, 22, 4))

    private = [
        ("password: ", lambda: token(7, "abcdefgh") + digits(2)), ("my passwort = ", lambda: token(11)), ("SSN ", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        ("please call ", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("the account is ", iban), ("use ", lambda: "AKIA" + token(16, "ABCDEFGHJKLMNPQRSTUVWXYZ234567")),
        ("api_key='", lambda: token(24)), ("secret: ", lambda: token(400)), ("iban ", lambda: iban().replace(" ", "")), ("device ", lambda: ":".join(token(2, "0123456789abcdef") for _ in range(6))),
        ("host ", lambda: ":".join(token(4, "0123456789abcdef") for _ in range(8))), ("date of birth: ", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1940, 2005)}"),
        ("née le ", lambda: f"{rng.randint(1, 28)} mars {rng.randint(1940, 2005)}"), ("phone: ", lambda: f"{digits(3)} {digits(3)} {digits(4)}"),
    ]
    public = [
        ("the order ", lambda: digits(8)), ("on ", lambda: f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)} at 12:{digits(2)}"), ("version ", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}-rc{digits(1)}"),
        ("chapter ", lambda: f"{digits(2)} and section {digits(2)}"), ("the password ", lambda: "policy was changed"), ("total = ", lambda: digits(5)), ("the token ", lambda: "economy grew"),
        ("room ", lambda: f"B{digits(3)}"), ("it took ", lambda: f"{digits(1)}h {digits(2)}min"), ("password: ", lambda: "required"), ("the std::vector of ", lambda: f"{digits(4)} items"),
    ]
    out = []
    for _ in range(n):
        (before, make), is_private = rng.choice(private), rng.random() < 0.5
        if not is_private:
            before, make = rng.choice(public)
        value = make()
        lead = f"{rng.choice(['Then', 'We said', 'Hier'])} and so {before}"
        after = "' was set" if before.endswith("'") else " was said."
        out.append((lead + value + after, len(lead), len(lead) + len(value) if is_private else None))
    return out


@pytest.mark.parametrize("learnt", ["other texts", "nothing"])
def test_spans_of_texts_outside_the_fit(spark, learnt):
    """Patterns that the fitted texts never had are scored by the classifier's weights."""
    texts = [f"token = \"{hashlib.sha1(str(k).encode()).hexdigest()}\" and number {k * 10**9 + 7}" for k in range(40)] if learnt != "nothing" else []
    model = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    hit = found = wanted = 0
    for text, a, b in planted(3, 1500):
        spans = {(x, y) for _, x, y in pii.all_spans(text, model)[1]}
        wanted += b is not None
        hit += b is not None and (a, b) in spans
        found += len(spans)
    assert hit >= 0.9 * wanted and hit >= 0.9 * found, (hit, wanted, found)


def test_no_part_of_a_long_value_stays(spark):
    model = pii.estimate({})
    long, quoted = "k3Y" * 2000, "four words of one " * 50
    assert pii.redacted(f"password: {long} end", model) == "password: <SECRET> end"
    assert pii.redacted(f'password = "{quoted}9z" end', model) == 'password = "<SECRET>" end'
    chained = "a=b&" * 30_000
    assert len(list(pii._values(chained))) == 1


def plain_personal_data(text, model):
    base = pii.base_spans(text)
    spans = base + sorted([c[:3] for c in pii.candidates(text, base) if model(c[3]) >= pii.THRESHOLD], key=lambda s: (pii.KINDS.index(s[0]), s[1]))
    line = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
    return (*[sum(s[0] == k for s in base) for k in pii.BASE], hashlib.sha256(line(base).encode()).hexdigest(), line(spans), len(spans) - len(base))


def test_personal_data_of_the_query_row_by_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = pii.fit(docs)
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.find_personal_data(docs).collect()}
    assert got == {r["doc_id"]: plain_personal_data(r["text"] or "", model) for r in docs.collect()}


def test_one_id_many_times_stays_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"good text number {k}") for k in range(200)] + [(k, f"words of {k} and more") for k in range(2, 30)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1)] * 200 + [(k, k % 2) for k in range(2, 30)], "doc_id long, quality int")
    seen, plain = [], quality.train
    try:
        quality.train = lambda b, s, cuts, y: seen.append((len(y), len(b))) or plain(b, s, cuts, y)
        for sample, numbers in ((1, 10**6), (500, 10**6), (500, 300)):
            quality.fit(docs, marks, sample=sample, numbers=numbers)
    finally:
        quality.train = plain
    assert seen[0][0] <= 1 and 20 <= seen[1][0] <= 29 and 0 < seen[2][0] < seen[1][0] and seen[2][1] <= 300


def test_scores_by_a_plain_sum(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["some words here", "zz !! 00", "", None, "é words"])], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, quality int"))
    for r in quality.score(docs, model).join(docs, "doc_id").collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        buckets, _ = quality.features(raw, np.array([0, len(raw)]))
        mean = sum(float(model[0][b]) for b in buckets) / max(1, len(buckets))
        assert abs(r["score"] - 1 / (1 + np.exp(-mean - model[1]))) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)


def test_bounds_are_lengths_of_documents_at_any_length(spark):
    sizes = [1, 2, 2, 5000, 5001, 9000, 9001, 20_011, 20_012, 40_003, 3, 0]
    got = packing.pack(spark.createDataFrame([(k, "w " * n) for k, n in enumerate(sizes)], "doc_id long, text string"), buckets=4).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == dict(enumerate(sizes)) and {r["bound"] for r in got} <= set(sizes)
    cost = lambda cut: sum(min(b for b in cut if b >= n) - n for n in sizes)
    best = min(cost((a, b, c, 40_003)) for a in sizes for b in sizes for c in sizes)
    assert sum(r["padding"] for r in got) == best and all(r["padding"] == r["bound"] - r["n_tokens"] for r in got)


def test_stages_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_chats_with_odd_rows_and_other_columns(spark):
    long = "many words < and \\ signs " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "yes"), (1, 1, "assistant", "yes"), (None, 0, "assistant", "no id"), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("c", "t", "i", "k", "found", "head", "body", "at", "span", "p", "n_turns")})
    out = chat.digests(chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text")))))
    said = {1: [rows[0], rows[1], rows[2]], None: [rows[4], rows[3]]}
    want = {k: (len(v), hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in v).encode()).hexdigest()) for k, v in said.items()}
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in out.collect()} == want
    assert chat.digests(chat.format_chats(turns.limit(0).withColumn("parts", chat.text_part(F.col("text"))))).count() == 0


def test_vectors_beside_other_columns(spark):
    rows = [(k, [float(k % 5), float(k % 3)]) for k in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    other = df.withColumns({c: F.lit("x") for c in ("query_id", "rank", "score", "block", "q", "x", "id", "v")})
    key = lambda d: sorted(tuple(r) for r in topk.exact_top_k(d).collect())
    assert key(other) == key(df) and len(key(df)) == 60


@pytest.mark.parametrize(("groups", "spread", "same"), [(6, 0.05, 0), (1, 1.0, 0), (4, 0.05, 150)])
def test_top_k_over_many_blocks(spark, groups, spread, same):
    """Many small blocks against brute force; where vectors are in groups, a query meets its own group's blocks only."""
    rng = np.random.default_rng(groups)
    centres = rng.normal(size=(groups, 24)) * 4
    x = centres[np.arange(400) % groups] + spread * rng.normal(size=(400, 24))
    x[: same] = x[0]
    whole = np.floor(64 * x).astype(np.int64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(df, query_every=10, k=5, row_block=40, query_block=16).collect())
    want = []
    for q in range(0, 400, 10):
        scores = whole @ whole[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-scores[i], i))[:5]
        want += [(q, k + 1, i, int(scores[i])) for k, i in enumerate(best)]
    assert got == sorted(want)
    placed, found = topk.place_rows(df, "vec_id", "embedding", 64, 40)
    queries = placed.where("id % 10 = 0").withColumn("floor", F.lit(None).cast("long"))
    everything = topk.open_blocks(queries, found).count()
    floors = spark.createDataFrame([(w[0], w[3]) for w in want if w[1] == 5], "id long, floor long")
    sent = topk.open_blocks(queries.drop("floor").join(floors, "id"), found).count()
    assert everything == 40 * (int(found["count"].sum()) - 1)
    assert sent < everything / 2 if groups > 1 else sent == everything


def test_kept_ids_are_bounded_by_bytes(monkeypatch):
    """Long pre-tokens count by their length: the kept ids start anew, and all ids stay right."""
    import public_tokenizers

    monkeypatch.setattr(bpe, "CACHED_BYTES", 20_000)
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = [f"{chr(97 + k) * 3000} word{k} again" for k in range(20)] * 2
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert codec.decode(ids).decode() == text
        assert codec.held <= 20_000 + 6 * 5 * 3000 and sum(map(len, codec.cache)) < 20_000
