"""Interaction of text filters over all orders of applying them: every part's table of masks, folded over all orders.

A document's mask says which filters it fails. All that an order of filters does to a document follows from its mask,
so documents are counted per part and mask, and the at most 32 cells of a part are folded instead of its documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters by letter; a filter's place is its bit in a mask.
LETTERS = "ABCDE"
#: White space between words, the least number of words, and the marks that filter D looks for.
SPACES, EDGES, LEAST_WORDS, MARKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r", 200, r"[#$%&*|]"
#: What a fold counts in each step of each order.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> tuple[Column, ...]:
    """Whether a text fails A (too few words), B (repeats itself), C (too many capitals), D (odd marks)."""
    inner = F.trim(text, F.lit(EDGES))
    words, some = F.split(inner, SPACES), (inner != "").cast("int")
    n, distinct = some * F.size(words), some * F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return n < LEAST_WORDS, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"), text.rlike(MARKS)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part, by the filters they fail and by their labels.

    E is decided without moving texts or bringing a text's copies together: copies are counted per part, labels and
    smallest id where they are read, and only these counts meet at the text's digest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bits = [F.when(hit, 1 << k).otherwise(0) for k, hit in enumerate(text_failures(F.col("_text")))]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.select("_id", "part", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_same"), sum(bits[1:], bits[0]).alias("_mask"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled"))
    known = known.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic"))
    rows = rows.join(known, F.col("_id") == F.col("_labelled"), "left")
    kind = ["_same", "part", "_mask", "good", "toxic"]
    rows = rows.select("_id", "_same", "part", "_mask", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"))
    each = rows.groupBy("_id", *kind).agg(F.count(F.lit(1)).alias("_n"))
    has_id = F.col("_id").isNotNull()
    counted = each.groupBy(*kind).agg(
        F.min("_id").alias("_first"),
        F.min_by("_n", "_id").alias("_firsts"),
        F.sum(F.when(has_id, F.col("_n")).otherwise(0)).alias("_with_id"),
        F.sum(F.when(has_id, 0).otherwise(F.col("_n"))).alias("_without"),
    )
    first = F.min("_first").over(Window.partitionBy("_same"))
    copies = F.col("_with_id") - F.when(F.col("_first") == first, F.col("_firsts")).otherwise(0)
    split = counted.withColumn("_copies", copies).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("_mask").alias("mask"), (F.col("_with_id") - F.col("_copies") + F.col("_without")).alias("n")),
            F.struct((F.col("_mask") + (1 << LETTERS.index("E"))).alias("mask"), F.col("_copies").alias("n")),
        )),
    )
    return split.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def all_orders() -> list[list[int]]:
    """Every order of the filters, as lists of their bits."""
    return [[1 << k for k in order] for order in permutations(range(len(LETTERS)))]


def _add(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])


def folded(cell: Column, orders: Column) -> Column:
    """What a cell (mask, n, good, toxic) adds to each step of each order: one list of structs of COUNTS."""
    count = lambda hit, n: F.when(hit, n).otherwise(F.lit(0)).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, alive = cell["mask"].bitwiseAND(bit) != 0, state["alive"]
        here = alive & fails
        now = (
            count(alive & ~fails, cell["n"]), count(here, cell["n"]), count(fails & ~alive, cell["n"]),
            count(cell["mask"] == bit, cell["n"]), count(here, cell["good"]), count(here, cell["toxic"]),
        )
        return F.struct((alive & ~fails).alias("alive"), F.concat(state["steps"], F.array(F.struct(*[v.alias(c) for c, v in zip(COUNTS, now, strict=True)]))).alias("steps"))

    shape = "array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(shape).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step)["steps"]))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, the COUNTS and shapley: one row per part, order of the filters and step of it.

    Each cell of a part is folded along every order, the order array going out with the plan: a list of one struct
    per order and step, weighted by the cell's documents. The lists of a part are added element by element. A part has
    at most 32 cells, whatever its size, so a part with a third of all documents costs what any other does.

    Null texts count as empty, null parts as the empty text. Rows repeating an id count each and are no copies of one
    another; a row without an id is no copy of any other and has no labels. Of several labels of an id, 1 counts if any says
    so. Labels of ids that docs lacks do nothing. An empty table gives an empty result; other columns are not looked at.
    """
    orders = all_orders()
    named = ["".join(LETTERS[bit.bit_length() - 1] for bit in order) for order in orders]
    own = cells(docs, labels, id_col, text_col, part_col)
    weighed = own.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    parts = weighed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    order_array = F.lit(orders)
    total = F.aggregate(
        "cells",
        F.array_repeat(zero, len(orders) * len(LETTERS)),
        lambda sums, cell: F.zip_with(sums, folded(cell, order_array), _add),
    )
    letter = lambda k: F.substr(F.element_at(F.lit(named), (F.floor(k / len(LETTERS)) + 1).cast("int")), (k % len(LETTERS) + 1).cast("int"), F.lit(1))
    rows = parts.select("part", total.alias("steps")).select("part", F.posexplode("steps").alias("k", "s")).select(
        "part",
        F.element_at(F.lit(named), (F.floor(F.col("k") / len(LETTERS)) + 1).cast("int")).alias("filter_order"),
        (F.col("k") % len(LETTERS) + 1).cast("int").alias("step"),
        *[F.col(f"s.{c}").alias(c) for c in COUNTS],
        letter(F.col("k")).alias("_letter"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).drop("_letter")
