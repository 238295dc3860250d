import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sigwarn.llm import bpe, chat, exact_dedup, jaccard, licenses, maxent_lm, packing, pii, quality, topk
from sigwarn.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split()


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n)) for n in (1, 2, 3, 40, 200, 3000)]
    near = []
    for k in range(12):
        w = base[4].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"edit{k}{rng.random()}"
        near.append(" ".join(w))
    return [*base, *base[:4], *near, None, "", " \t\n", "x" * 9000]


def test_exact_dedup(spark, texts):
    got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_chunks_are_the_whole_text(spark, texts):
    from pyspark.sql import functions as F

    df = documents(spark, [t for t in texts if t])
    assert df.where(F.array_join(exact_dedup.chunks(F.col("text"), 5, 40), "") != F.col("text")).count() == 0


def test_hash_collisions_of_chunks_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "chunk_hash", lambda c: F.length(c).cast("long"))
    got = exact_dedup.exact_duplicates(documents(spark, ["aa", "bb", "aa", "c"])).orderBy("doc_id").collect()
    assert [r["keep_id"] for r in got] == [2, 1, 2, 3]


def test_rows_equal_in_id_and_text_become_one(spark):
    df = documents(spark, ["a", "a", "b"])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df.unionByName(df)).collect()) == [1, 2]


def brute_components(texts, n, percent):
    def shingles(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [shingles(t) for t in texts]
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    root, last = list(range(len(sets))), None
    while last != root:
        last = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    return sets, root


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, texts, n, percent):
    sets, root = brute_components(texts, n, percent)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(documents(spark, texts), n=n, percent=percent).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(sets))] == [(len(s), root[i]) for i, s in enumerate(sets)]
    kept = {r["doc_id"] for r in jaccard.drop_near_duplicates(documents(spark, texts), n=n, percent=percent).collect()}
    assert kept == {i for i, s in enumerate(sets) if not s or root[i] == i}


@pytest.mark.parametrize(("n", "percent", "small"), [(3, 90, 16), (3, 90, 1), (5, 80, 1)])
def test_jaccard_in_large_groups_that_one_set_does_not_connect(spark, monkeypatch, n, percent, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rng, made = random.Random(n * 100 + small), []
    for length, edits in ((60, 2), (130, 3), (131, 4), (400, 14)):
        base = [f"w{length}x{i}" for i in range(length)]
        choices = [(rng.randrange(length), f"new{k}") for k in range(edits * 4)]
        for _ in range(45):
            w = list(base)
            for at, word in rng.sample(choices, rng.randint(1, edits)):
                w[at] = word
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"own{rng.random()}"
            made.append(" ".join(w[: rng.choice((length, length - 2))]))
    rng.shuffle(made)
    sets, root = brute_components(made, n, percent)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(documents(spark, made), n=n, percent=percent).collect()}
    assert [got[i] for i in range(len(sets))] == root
    assert 4 < len(set(root)) < len(root) - 20


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)}


def test_quality_learns_from_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) + ("!!" if i % 2 else "") for _ in range(30)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = documents(spark, [*texts, None, ""])
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [r for i, r in got.items() if r["held_out"] and i < 200]
    assert held and all(r["predicted"] == 1 - r["doc_id"] % 2 for r in held)
    assert got[200]["score"] == got[201]["score"] and 0 <= got[200]["score"] <= 1
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_small_partitions_train_together(spark, texts, monkeypatch):
    seen, whole = [], maxent_lm._round
    monkeypatch.setattr(maxent_lm, "_round", lambda rows, model: (seen.append(rows.rdd.getNumPartitions()), whole(rows, model)))
    maxent_lm.fit(documents(spark, texts).repartition(37))
    assert len(seen) == maxent_lm.ROUNDS and max(seen) <= spark.sparkContext.defaultParallelism


def test_language_model_is_a_distribution_and_beats_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(f"{w}{k % 2}" for k, w in enumerate(rng.choices(WORDS, k=60))) for _ in range(120)] + [None, "never seen"]
    got = maxent_lm.score(documents(spark, texts)).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    empty = next(r for r in got if r["doc_id"] == 120)
    assert empty["n_tokens"] == 1
    model = maxent_lm.fit(documents(spark, texts))[0]
    p, q = model.outputs(np.array([0]), np.zeros((5, 1), int), np.zeros((4, 1), int))
    assert abs(p.sum() - 1) < 1e-5 and abs(q.sum() - 1) < 1e-5


def test_probabilities_of_all_tokens_sum_to_one(spark):
    from sigwarn.llm.words import Words

    rng = random.Random(9)
    texts = [" ".join(f"{rng.choice(WORDS)}{rng.randint(0, 60)}{rng.choice(['', '!'])}" for _ in range(60)) for _ in range(100)]
    model, _, _, distinct = maxent_lm.fit(documents(spark, texts))
    assert distinct > 2 * maxent_lm.HEAD
    words = sorted({w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    data = np.frombuffer(" ".join(["alpha0 beta1 gamma2", *words]).encode(), np.uint8)
    h, shape, _, _ = maxent_lm.tokens(Words(data, np.array([0, len(data)])))
    one_text = np.zeros(4, np.int64)
    known = unseen = 0.0
    for x, s in zip(h[3:], shape[3:], strict=True):  # all known words and the end after the same three words
        group, place, in_class, in_word = model.context(np.array([*h[:3], x]), np.array([*shape[:3], s]), one_text)
        count = model.counts[model.index(np.array([x]))[0]] + maxent_lm.ADD if group[3] >= maxent_lm.GROUPS else 1.0
        known += 10 ** model.log10(group, place, in_class, in_word)[3] * count
    for g in range(maxent_lm.SHAPES):  # what each cell keeps for words never seen
        group, _, in_class, in_word = model.context(np.array([*h[:3], 12345], np.uint64), np.array([*shape[:3], g]), one_text)
        p, q = model.outputs(group[3:], in_class[:, 3:], in_word[:, 3:])
        unseen += p[0, maxent_lm.GROUPS + g] * (q[0] * maxent_lm.ADD / (model.tail[g] + maxent_lm.ADD * (model.types[g] + 1))).sum()
    assert abs(known + unseen - 1) < 1e-4


def test_base_columns_equal_brute_force(spark, texts):
    got = {r["doc_id"]: r for r in maxent_lm.score(documents(spark, texts)).collect()}
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    seen = {}
    for i, t in enumerate(texts):
        for w in () if held(i) else cut(t):
            seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    for i, t in enumerate(texts):
        w, r = cut(t), got[i]
        base = sum(math.log10((seen.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(x in seen for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)


def test_byte_bpe_equals_tiktoken(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", " ", "\n", "'s", "1", "汉", "🙂", "▁", "the", "!!", "<unk>", "\x00"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(documents(spark, texts), path, P.PATTERN, digests=False).collect()}
    assert all(got[i] == enc.encode_ordinary(t or "") for i, t in enumerate(texts))
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(bpe.encode(documents(spark, texts), path, P.PATTERN, digests=False), path).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(60):
        size = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        n = [rng.randint(1, 9) for _ in size]
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(size, n, strict=True))  # noqa: B023, E731
        best = min(cost([*c, size[-1]]) for k in range(3) for c in combinations(size[:-1], k))
        assert cost(packing.boundaries(np.array(size), np.array(n), 3)) == best


def test_batches_keep_every_row_and_the_budget(spark, texts):
    got = packing.pack(documents(spark, texts), budget=500, shard_rows=5).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    assert all(r["padding"] >= 0 for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(r)
    assert all(len(b) == 1 or len(b) * b[0]["bound"] <= 500 for b in batches.values())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=10).tolist()) for i in range(200)] + [(i, [0.5] * 10) for i in range(200, 260)] + [(300, None), (320, [float("nan")] * 10), (340, [1.0, None]), (None, [1.0] * 10)]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20).collect()
    ids = np.array([r[0] for r in rows[:260]])
    v = np.floor(np.array([r[1] for r in rows[:260]], dtype=np.float32).astype(np.float64) * 64).astype(np.int64)
    for q in ids[ids % 20 == 0]:
        s = v @ v[q]
        want = [(int(i), int(s[i])) for i in np.lexsort((ids, -s)) if i != q][:20]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == set(ids[ids % 20 == 0])


def test_chat_round_trip_and_attachments(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", "<a>\\ </turn>"), part("image", None, "i.png", 64), part("document", None, "d.pdf", None)]), (1, 1, "assistant", [part("text", "\\<\n</turn>\n")]), (1, 2, "as\n<\\", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PART_SCHEMA}")
    r = chat.read_back(chat.format_chats(df)).first()
    assert [t["role"] for t in r["turns"]] == ["user", "assistant", "as\n<\\"]
    assert r["turns"][0]["text"] == "<a>\\ </turn><image 0><document 1>" and r["turns"][1]["text"] == "\\<\n</turn>\n"
    assert [(a["k"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 0, "image", "i.png", 64), (1, 0, "document", "d.pdf", 0)]
    a = r["loss_spans"][0]
    assert r["formatted"][a["start"] : a["end"]] == "\\\\\\<\n\\</turn>\n"


def test_license_rules_need_order(spark):
    grant, keep = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-keep"]
    texts = [f"{grant}.\n{keep}.", f"{keep}.\n{grant}.", f"{grant}.\nother words.\n{keep}.", "Released under the MIT License.", None, "Licensed under CC BY-NC 4.0.\nX"]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == ["MIT", "", "", "MIT", "", "CC-BY-NC-4.0"]


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
KEEP = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
MIT = f"""MIT License

Copyright (c) 2020 A. Person

{GRANT}
{KEEP}
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
GPL = """This file is part of Thing.

Thing is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

Thing is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
BSD = """Copyright 2011, Some Company Inc.
All code below.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of Some Company Inc. nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY SOME COMPANY INC. AND CONTRIBUTORS "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE HOLDER BE LIABLE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of
the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""
CC = """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License.
"""


BSD_TEXT = "BSD,BSD-3-Clause" if "either the name" in BSD else "BSD"


def test_complete_wrapped_licenses_are_found(spark):
    hashed, starred = ("\n".join(f"{mark} {x}".rstrip() for x in BSD.splitlines()) for mark in ("#", " *"))
    one_line = "\n\n".join(" ".join(p.split()) for p in MIT.split("\n\n"))
    old, far = GPL.replace("version 3", "version 2"), GRANT + "\n" + "Other words. " * 9 + "\n\n" + KEEP
    cases = [(MIT, "MIT"), (one_line, "MIT"), (MIT.replace("\n", "\r\n"), "MIT"), (GPL, "GPL-3.0"), (old, "GPL-2.0"), (BSD, BSD_TEXT), (hashed, BSD_TEXT), (starred, BSD_TEXT)]
    cases += [(APACHE, "Apache-2.0"), (CC, "CC-BY-SA-4.0"), (GRANT, ""), (KEEP + "\n" + GRANT, ""), (far, "MIT"), (MIT + "\n" + BSD, "MIT," + BSD_TEXT)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, [t for t, _ in cases])).collect()}
    assert [got[i]["licenses"] for i in range(len(cases))] == [want for _, want in cases]
    assert got[0]["sentence_ids"] == "mit-grant,mit-keep" and got[0]["n_known"] == 2


def test_base_spans_equal_the_plain_rules():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        out = [("email", *m.span()) for m in email.finditer(t)] + [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in card.finditer(t):
            d = re.sub("[ -]", "", m.group())
            if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]

    rng = random.Random(7)
    for _ in range(20000):
        t = "".join(rng.choice("a.@1+ -()B4%é9_0") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain(t), t


def test_personal_data_is_replaced(spark):
    texts = ["mail a.b@c.org now", None, "", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "plain words only"] + ['token = "%040x" x' % (7**k) for k in range(30, 45)]
    got = {r["doc_id"]: r for r in pii.redact(documents(spark, texts), chars_col="n_chars").collect()}
    assert got[0]["text"] == "mail <EMAIL> now" and got[0]["n_chars"] == 16 and got[1]["text"] is None and got[4]["text"] == texts[4]


def test_short_and_grouped_personal_data_is_replaced(spark):
    secret = ["hunter2", "correcthorse", "s3!", "p@ss word"]
    texts = [f"login password: {secret[0]}, then", f"passwort = {secret[1]} und", f"clave: '{secret[2]}' fin", f'DB_PASSWORD="{secret[3]}"']
    texts += ["call (555) 123-4567 now", "phone: 555 123 4567.", "Tel. 030 1234567 ok", "IBAN DE89 3704 0044 0532 0130 00 BIC X", "pays DE89 3704 0044 0532 0130 00"]
    want = ["login password: <SECRET>, then", "passwort = <SECRET> und", "clave: '<SECRET>' fin", 'DB_PASSWORD="<SECRET>"']
    want += ["call <NUMBER> now", "phone: <NUMBER>.", "Tel. <NUMBER> ok", "IBAN <NUMBER> BIC X", "pays <NUMBER>"]
    clean = ["the password was reset by the clerk", "Note: bring apples", "open 2024-01-02 12 to 14", "a phone call later", "password = get_password(user)", "rows 100-2000 of 30 400 500"]
    tokens = ['token = "%040x" x' % (7**k) for k in range(30, 45)]
    # whichever candidates are many
    for more in (tokens, ["see part %d: done" % k for k in range(400)], ["at 98079157628%05d on" % k for k in range(400)]):
        got = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts + clean + more)).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert [got[len(texts) + i] for i in range(len(clean))] == clean


def test_empty_tables(spark):
    none = documents(spark, ["a"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert maxent_lm.score(none).count() == 0
    assert packing.pack(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


NOTICES = {
    "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "This project is licensed under the MIT License - see the LICENSE file": "MIT", "Released under the MIT license, enjoy.": "MIT", "It is released under the ISC license.": "ISC",
    "Distributed under the terms of the GNU General Public License v2": "GPL-2.0", "Licensed under the GNU Lesser General Public License version 2.1 or later": "LGPL-2.1", "Licensed under the GNU Affero General Public License v3.0": "AGPL-3.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0", "available under the BSD 2-Clause License": "BSD-2-Clause", "Licensed under the BSD-3-Clause license": "BSD-3-Clause", "released under the GPLv3": "GPL-3.0",
    "This text is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0", "Published under CC BY 3.0": "CC-BY-3.0", "Published under CC BY-NC-SA 4.0 by us": "CC-BY-NC-SA-4.0", "Licensed under the Apache License 2.0, see below": "Apache-2.0",
    "Copyright 2020 Somebody. All rights reserved.": "Proprietary", "Copyright 2020 Somebody. All rights reserved.\nSPDX-License-Identifier: ISC": "ISC", "We talked about the MIT license and its history.": "", "The house was released under protest, by the mob.": "", "Subject to the weather, apache 2 flies.": "",
}


def test_notices_as_they_are_written(spark):
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, list(NOTICES))).collect()}
    assert {t: got[i] for i, t in enumerate(NOTICES)} == NOTICES


def test_texts_of_the_gnu_family_and_many_conditions(spark):
    of = lambda kind, v: GPL.replace("GNU General", f"GNU {kind}General").replace("version 3", f"version {v}")
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    owned = BSD.replace("Redistribution and use", "Copyright (c) 2019, The Authors. All rights reserved.\n\nRedistribution and use", 1)
    long = BSD.replace("THIS SOFTWARE", "\n".join(f"{k}. Another condition of this owner." for k in range(4, 60)) + "\n\nTHIS SOFTWARE", 1)
    cases = [(of("Lesser ", "2.1"), "LGPL-2.1"), (of("Lesser ", "3"), "LGPL-3.0"), (of("Affero ", "3"), "AGPL-3.0"), (of("", "2"), "GPL-2.0"), (isc, "ISC"), (owned, BSD_TEXT), (long, BSD_TEXT)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(documents(spark, [t for t, _ in cases])).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
