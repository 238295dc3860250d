"""One query per operator of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwarn.llm import bpe, chat, exact_dedup, filter_audit, jaccard, licenses, line_dedup, maxent_lm, packing, pii, prefix_trie, quality, topk

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text")))))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.elements(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie_of(prefix_trie.with_borrowed_heads(own))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(docs, line_dedup.line_bitmaps(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_quality, op3_maxent_lm, op4_byte_bpe, op5_length_buckets, op6_exact_top_k, op7_chat_format, op8_license_scan, op9_jaccard_join, op10_pii, op11_filter_audit, op12_prefix_trie, op13_line_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    word = r"[^\x20\x09-\x0D]+"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(s)}: {quote(name)}" for name, s in licenses.SENTENCES.items()) + "}"
    all_rules = {name: licenses.RULES.get(name, []) + ([[f"name:{name}"], [f"tag:{name}"]] if name in licenses.NAMES else []) for name in dict.fromkeys([*licenses.RULES, *licenses.TEXT_RULES, *licenses.NAMES])}
    rules = ", ".join(f"CASE WHEN {' OR '.join('contains(line, ' + quote(',' + ','.join(v) + ',') + ')' for v in variants)} THEN {quote(name)} END" for name, variants in all_rules.items() if variants)
    named = ", ".join(f"CASE WHEN regexp_matches(x, {quote(pattern)}) THEN {quote(name)} END" for name, pattern in licenses.named_patterns().items())
    fails = ", ".join(filter_audit.LETTERS.lower())
    escaped = r"replace(replace({}, '\', '\\'), '<', '\<')"
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
                sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op6_exact_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e)::BIGINT AS score
                FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
            r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 20""",
        "op7_chat_format": rf"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
            e AS (SELECT *, length({escaped.format("role")}) AS n, length({escaped.format("text")}) AS m FROM c)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                sum(6 + length(n::VARCHAR) + 1 + n + 1 + m + 9)::BIGINT AS formatted_chars
            FROM e GROUP BY conv_id""",
        "op8_license_scan": rf"""
            WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '{licenses.STOP}', '\1' || chr(10) || '\2', 'g'), '{licenses.LINES}'), lambda x: x <> '') AS s FROM documents),
            m AS (SELECT doc_id, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '{licenses.MARKS}')
                THEN trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) ELSE '' END) AS s FROM s),
            i AS (SELECT doc_id, list_transform(s, lambda x: CASE WHEN ({known})[x] IS NOT NULL THEN [({known})[x]]
                WHEN regexp_matches(x, '{licenses.GRANTED}|{licenses.TAGGED}') THEN list_filter([{named}], lambda y: y IS NOT NULL) ELSE [] END) AS ids FROM m),
            j AS (SELECT doc_id, len(ids) AS n, flatten(list_transform(ids, lambda x: CASE WHEN len(x) = 0 THEN [''] ELSE x END)) AS ids FROM i),
            k AS (SELECT doc_id, n, list_filter(ids, lambda x: x <> '') AS known, ',' || array_to_string(ids, ',') || ',' AS line FROM j),
            g AS (SELECT *, list_filter([{rules}], lambda x: x IS NOT NULL) AS hits FROM k),
            f AS (SELECT *, CASE WHEN len(hits) > 1 THEN list_filter(hits, lambda x: x <> '{licenses.ALONE}') ELSE hits END AS found FROM g)
            SELECT doc_id, n::BIGINT AS n_sentences, len(known)::BIGINT AS n_known, coalesce(array_to_string(known, ','), '') AS sentence_ids,
                coalesce(array_to_string(found, ','), '') AS licenses, len(found)::BIGINT AS n_licenses FROM f""",
        "op9_jaccard_join": rf"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a),
            m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id""",
        "op11_filter_audit": rf"""
            WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
            k AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
            f AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c,
                regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
                FROM t LEFT JOIN k USING (doc_id)),
            x AS (SELECT part, [{fails}] AS fails, good, toxic FROM f),
            l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
            o AS (SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM l l1, l l2, l l3, l l4, l l5 WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
            p AS (SELECT *, coalesce(list_position(list_transform(generate_series(1, 5), lambda i: fails[ascii(filter_order[i]) - 64]), true), 6) AS first FROM x, o),
            s AS (SELECT part, filter_order, step::INTEGER AS step, filter_order[step] AS letter, first, fails[ascii(filter_order[step]) - 64] AS hit,
                list_sum(list_transform(fails, lambda y: y::INTEGER)) AS n_fails, good, toxic FROM p, generate_series(1, 5) AS g(step)),
            n AS (SELECT part, filter_order, step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
                count(*) FILTER (hit AND first < step) AS redundant, count(*) FILTER (hit AND n_fails = 1) AS unique_fails,
                count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
            SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM n""",
        "op12_prefix_trie": r"""
            WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
                FROM conversations WHERE conv_id IS NOT NULL),
            c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 9 AS h
                FROM (SELECT DISTINCT conv_id FROM t)),
            r AS (SELECT c.conv_id, 0 AS part, k, role, text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL
                SELECT c.conv_id, 1, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d FROM r),
            g AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY d) AS s FROM o GROUP BY conv_id),
            s AS (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN g USING (conv_id)),
            p AS (SELECT conv_id, d AS depth, s[1:d] AS path, len(s) = d AS ends, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS size FROM s, LATERAL (SELECT unnest(generate_series(0, len(s))) AS d)),
            n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY path, depth),
            u AS (SELECT depth, conv_id, path, size, n_convs, ends_sha256, path[1:depth - 1] AS up FROM n),
            k AS (SELECT up, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY up),
            w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.up = u.path),
            a AS (SELECT path[1:j] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
                FROM w, LATERAL (SELECT unnest(generate_series(0, depth)) AS j) GROUP BY ALL)
            SELECT w.conv_id, w.depth, v.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
            FROM w JOIN a ON a.path = w.path LEFT JOIN n v ON v.path = w.up AND w.depth > 0""",
        "op13_line_dedup": rf"""
            WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
            l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
                FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM t))),
            k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
            m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.last AS gone FROM l LEFT JOIN k ON l.key = k.key)
            SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r""",
    }
