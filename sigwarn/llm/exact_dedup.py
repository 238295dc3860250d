"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwarn.llm.store import discard, id_of_any_name, kept_rows, materialize

#: A chunk has at least this many characters (but for the last) and ends at the next white space after a vowel or a
#: full stop, or at the largest size. Where it ends depends on the text near the end alone.
LEAST, MOST = 768, 4096


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; together they are the text. An empty text has none, a null one null.

    A text without white space after a vowel or stop is cut every `most` characters.
    """
    rule = rf"(?s).{{{least},{most}}}?(?<=[aeiou.]\s)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


@id_of_any_name("keep_id", "group_size", "kept", "text_sha256", "n_chunks")
def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, n_chunks.

    Every text becomes a recipe: the ordered identifiers of its chunks. A chunk's identifier is its 64-bit hash and
    an ordinal among the distinct chunks that have this hash, 0 nearly always: all distinct chunks of the corpus are
    compared by their content once, and where a hash has several contents, the recipes that use it get the ordinals.
    Texts are equal when their recipes are. Long texts are never moved to compare them: chunks move once, after
    duplicates are merged on the map side, and then lists of numbers do. The largest id of a group stays.

    Null texts count as empty, empty texts are equal to each other. A null id loses to any other; of rows that repeat
    the largest id of a group only one stays. An empty table gives an empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    recipes = materialize(_recipes(base.withColumn("_row", F.monotonically_increasing_id()), least, most))
    distinct = (
        base.select(F.explode(chunks(F.col("_text"), least, most)).alias("_chunk"))
        .select(chunk_hash(F.col("_chunk")).alias("_hash"), "_chunk")
        .distinct()
    )
    shared = distinct.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    shared = materialize(shared)
    marked = recipes.withColumn("_ordinals", F.lit(None).cast("array<long>"))
    if not shared.isEmpty():
        discard(recipes)
        marked = _with_ordinals(base, shared, least, most)
    else:
        discard(shared)
    same = ["_recipe", "_ordinals"]
    groups = marked.groupBy(*same).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_id", "_row")).alias("_best"))
    on = (F.col("d._recipe") == F.col("g._recipe")) & F.col("d._ordinals").eqNullSafe(F.col("g._ordinals"))
    return (
        marked.alias("d")
        .join(groups.alias("g"), on)
        .select(
            F.col("_id").alias(id_col),
            F.col("_best._id").alias("keep_id"),
            "group_size",
            (F.col("_best._row") == F.col("_row")).alias("kept"),
            "text_sha256",
            F.size("d._recipe").cast("long").alias("n_chunks"),
        )
    )


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _recipes(rows: DataFrame, least: int, most: int) -> DataFrame:
    recipe = F.transform(chunks(F.col("_text"), least, most), lambda c: chunk_hash(c)).alias("_recipe")
    return rows.select("_id", "_row", recipe, F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))


def _with_ordinals(base: DataFrame, shared: DataFrame, least: int, most: int) -> DataFrame:
    """Recipes with the ordinals of chunks whose hash several contents have; only such chunks move again.

    Row numbers have to mean the same row in both uses, so the rows are written with their numbers first.
    """
    rows = materialize(base.withColumn("_row", F.monotonically_increasing_id()))
    parts = rows.select("_row", F.posexplode(chunks(F.col("_text"), least, most)).alias("_pos", "_chunk"))
    parts = materialize(parts.withColumn("_hash", chunk_hash(F.col("_chunk"))).join(shared, "_hash", "left_semi"))
    order = F.row_number().over(Window.partitionBy("_hash").orderBy("_chunk"))
    ids = parts.select("_hash", "_chunk").distinct().withColumn("_ordinal", order.cast("long") - 1)
    used = parts.join(ids, ["_hash", "_chunk"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_ordinal"))).alias("_o"))
    used = used.select("_row", F.transform("_o", lambda x: x["_ordinal"]).alias("_ordinals"))
    out = materialize(_recipes(rows, least, most).join(used, "_row", "left"))
    for table in (rows, parts, shared):
        discard(table)
    return out


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates() keeps, with all columns of docs, whatever their names.

    Rows equal in id and text become one. Null texts count as empty and are equal to empty ones, so one row of them
    stays; a null id loses to any other. An empty table gives an empty result.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    found = exact_duplicates(docs.select(id_col, text_col), id_col, text_col)
    verdict = found.groupBy(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_same")).agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    verdict = materialize(verdict.where("not _kept or _n > 1").drop("_n"))
    return kept_rows(docs, verdict, id_col, sha)
