"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation becomes one string of turns ``<turn N>role\\ntext\\n</turn>\\n``, N being the length of the escaped role.
Inside roles and texts every ``\\`` and ``<`` has a ``\\`` before it, so that no control string, all of which begin
with a bare ``<``, can come from them, and removing the escapes gives back the text.

Content is a list of typed parts. Text goes in escaped; an image, audio clip or document becomes a placeholder
``<type k>`` with its number k in the conversation, and its reference and expanded token count are kept in a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from sigwarn.llm.store import id_of_any_name
from pyspark.sql import functions as F

PART_SCHEMA = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
ATTACHMENTS = ("image", "audio", "document")
TURN_END = "\n</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content list of one text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(PART_SCHEMA)


def parts_of_json(content: Column) -> Column:
    """Parts of a JSON list of {type, text, ref, tokens}; what isn't such a list is one text part."""
    read = F.from_json(content, PART_SCHEMA)
    return F.when(content.startswith("[") & read.isNotNull(), read).otherwise(text_part(content))


def _visit(parts: Column, before: Column) -> Column:
    """The parts as one string; attachments are numbered from `before` on."""
    kept = F.filter(F.coalesce(parts, F.array().cast(PART_SCHEMA)), lambda p: p.isNotNull())
    is_attachment = lambda p: F.coalesce(p["type"], F.lit("text")).isin(*ATTACHMENTS)
    start = F.struct(F.lit("").alias("s"), before.cast("int").alias("k"))
    step = lambda acc, p: F.struct(
        F.concat(acc["s"], F.when(is_attachment(p), F.concat(F.lit("<"), p["type"], F.lit(" "), acc["k"].cast("string"), F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("s"),
        (acc["k"] + is_attachment(p).cast("int")).alias("k"),
    )
    return F.aggregate(kept, start, step)["s"]


@id_of_any_name("n_turns", "formatted", "loss_spans", "attachments", param="conv_col")
def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments.

    loss_spans are (turn, start, end) in code points of the formatted string, the end exclusive, of what learn_role
    said, in order. attachments are (k, turn, type, ref, tokens) in order; a null token count counts as 0.

    Turns are ordered by turn_col, ties by role and then by content, nulls first; null roles and null lists of parts
    count as empty. Unknown part types count as text. Repeated rows are turns each. Rows with a null conversation id
    form one conversation. An empty table gives an empty result; other columns are not looked at. A conversation is
    one string, so it must be below Spark's limit for a string.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    parts = F.filter(F.coalesce(F.col(parts_col), F.array().cast(PART_SCHEMA)), lambda p: p.isNotNull())
    found = F.filter(parts, lambda p: F.coalesce(p["type"], F.lit("text")).isin(*ATTACHMENTS))
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), role.alias("role"), parts.alias("parts"), found.alias("found"))
    order = Window.partitionBy("c").orderBy("t", "role", "parts")
    rows = rows.withColumn("i", F.row_number().over(order) - 1)
    in_order = Window.partitionBy("c").orderBy("i")
    rows = rows.withColumn("k", (F.sum(F.size("found")).over(in_order) - F.size("found")).cast("int"))
    header = F.concat(F.lit("<turn "), F.length(escape(F.col("role"))).cast("string"), F.lit(">"), escape(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", header).withColumn("body", _visit(F.col("parts"), F.col("k")))
    size = F.length("head") + F.length("body") + len(TURN_END)
    rows = rows.withColumn("at", F.sum(size).over(in_order) - size)
    span = F.when(F.col("role") == learn_role, F.struct(F.col("i").alias("turn"), (F.col("at") + F.length("head")).alias("start"), (F.col("at") + F.length("head") + F.length("body")).alias("end")))
    numbered = F.transform("found", lambda p, j: F.struct((F.col("k") + j).alias("k"), F.col("i").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))
    piece = F.struct("i", F.concat("head", "body", F.lit(TURN_END)).alias("s"), span.alias("span"), numbered.alias("found"))
    grouped = rows.groupBy("c").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return grouped.select(
        F.col("c").alias(conv_col),
        F.size("p").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("p", lambda x: x["found"])).alias("attachments"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """chats with `turns`, read from the formatted string alone: (role, text, raw_start) of each turn.

    raw_start is where the escaped text begins in its turn. Placeholders stay in the text as they are. A null or empty string
    has no turns; rows and other columns stay as they are, repeated rows too, and an empty table stays empty.
    """
    pieces = F.filter(F.split("formatted", r"\n</turn>\n"), lambda s: s != "")
    width = lambda s: F.regexp_extract(s, r"^<turn ([0-9]+)>", 1)
    start = lambda s: F.length(width(s)) + 7 + width(s).cast("int") + 1
    turn = lambda s: F.struct(
        unescape(F.substr(s, F.length(width(s)) + 8, width(s).cast("int"))).alias("role"),
        unescape(F.substr(s, start(s) + 1)).alias("text"),
        F.substr(s, start(s) + 1).alias("raw"),
        start(s).alias("raw_start"),
        (F.length(s) + len(TURN_END)).alias("size"),
    )
    return chats.withColumn("turns", F.transform(pieces, turn))


def read_parts(raw: Column) -> Column:
    """The typed parts of the escaped text of a turn, in order: (type, text, k), k numbering an attachment in its conversation.

    A placeholder is a part; text that only looks like one is escaped and stays text. Neighbouring text parts come
    back as one, empty ones don't come back, and parts of unknown types come back as text.
    """
    pieces = F.regexp_extract_all(raw, F.lit(rf"(?s)<(?:{'|'.join(ATTACHMENTS)}) [0-9]+>|(?:[^<\\]|\\.)+"), F.lit(0))
    of = lambda p, g: F.regexp_extract(p, "^<([a-z]+) ([0-9]+)>$", g)
    attachment = lambda p: F.struct(of(p, 1).alias("type"), F.lit(None).cast("string").alias("text"), F.try_to_number(of(p, 2), F.lit("9999999999")).cast("int").alias("k"))
    text = lambda p: F.struct(F.lit("text").alias("type"), unescape(p).alias("text"), F.lit(None).cast("int").alias("k"))
    return F.transform(pieces, lambda p: F.when(p.startswith("<"), attachment(p)).otherwise(text(p)))


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted string.

    One row per row of chats, with a null conv_id as well; a conversation without turns that learn has loss_chars 0 and the
    digest of the empty text. An empty table gives an empty result.
    """
    chats = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # the mask's spans cut the raw text of their turn; their lengths are taken from the spans
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at("turns", s["turn"] + 1)["raw"], F.lit(1), (s["end"] - s["start"]).cast("int"))))
    out = chats.withColumn("_said", said).withColumn("_loss", F.array_join(masked, ""))
    return out.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("_said").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
