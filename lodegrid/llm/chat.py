"""Chat formatting by prefix-target expansion, in DataFrame expressions alone.

Every assistant turn is exploded into an example, a row of its own (``examples``): its
target, the only trainable text, the loss mask within it, and its context, all turns
before it.  The contexts of one conversation are prefixes of one another, so the formatted
conversation is stored once, in pages of at most ``PAGE_TURNS`` turn numbers, and an
example names its context by where it ends there.  ``render`` writes contexts out as texts
for those who want them so; the stored form grows with the turns, not with their square.

Template: ``### role: text</turn>`` and a line feed.  Inside roles and texts a
backslash is doubled, ``###`` becomes ``\\###`` and ``</turn>`` becomes
``<\\/turn>`` (and ``:`` in a role ``\\:``), which ``unescape`` reverses.

Defined cases: null text or role is empty; turns are ordered by number (null
first), then role, then text, so repeated rows stay side by side and count each;
a null conv_id is a conversation of its own; a conversation without an assistant
has pages and no example; a very long text is in one page with its turn; an empty table
gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers in one stored page.
PAGE_TURNS = 64
END = "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pages of formatted conversations: conv_id, page, base, text, n_turns, examples.

    ``base`` is the number of characters of the conversation before the page.
    ``examples`` has for each assistant turn of the page: context_end, loss_start
    and loss_end, counted from the start of the conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit("### "), escape(role, True), F.lit(": "))
    body = escape(text)
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / PAGE_TURNS), F.lit(-(2**62))).cast("bigint").alias("page"),
        F.struct(
            F.col("turn"), role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(END)).alias("line"),
            F.length(head).cast("bigint").alias("head"), F.length(body).cast("bigint").alias("body"),
        ).alias("t"),
    )
    paged = rows.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<context_end:bigint,loss_start:bigint,loss_end:bigint>>)").alias("examples"))

    def add(acc: Column, t: Column) -> Column:
        first = acc["at"] + t["head"]
        example = F.struct(acc["at"].alias("context_end"), first.alias("loss_start"), (first + t["body"]).alias("loss_end"))
        return F.struct(
            (first + t["body"] + len(END)).alias("at"),
            F.when(t["role"] == ASSISTANT, F.concat(acc["examples"], F.array(example))).otherwise(acc["examples"]).alias("examples"),
        )

    laid = paged.select(
        "conv_id", "page", F.array_join(F.transform("ts", lambda t: t["line"]), "").alias("text"),
        F.size("ts").cast("bigint").alias("n_turns"), F.aggregate("ts", start, add).alias("laid"),
    )
    before = Window.partitionBy("conv_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    based = laid.withColumn("base", F.coalesce(F.sum("laid.at").over(before), F.lit(0)))
    moved = F.transform(
        "laid.examples",
        lambda x: F.struct((x["context_end"] + F.col("base")).alias("context_end"), (x["loss_start"] + F.col("base")).alias("loss_start"), (x["loss_end"] + F.col("base")).alias("loss_end")),
    )
    return based.select("conv_id", "page", "base", "text", "n_turns", moved.alias("examples"))


def examples(pages: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, page, context_end, target (the turn, formatted), and the loss mask loss_at and loss_chars in it."""
    x = pages.select("conv_id", "page", "base", "text", F.inline("examples"))
    target = F.substring("text", (F.col("context_end") - F.col("base") + 1).cast("int"), (F.col("loss_end") - F.col("context_end") + len(END)).cast("int"))
    return x.select("conv_id", "page", "context_end", target.alias("target"), (F.col("loss_start") - F.col("context_end")).alias("loss_at"), (F.col("loss_end") - F.col("loss_start")).alias("loss_chars"))


def render(pages: DataFrame) -> DataFrame:
    """Examples as texts: conv_id, loss_start, context, target (with its mark), loss_text as stored.

    Each example repeats its context, so this grows with the square of a
    conversation's turns; ask for it where conversations are known to be short.
    """
    own = pages.select("conv_id", "base", "text", F.inline("examples"))
    prior = pages.select(F.col("conv_id").alias("c"), F.col("base").alias("b"), F.col("text").alias("t"))
    joined = own.join(prior, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") <= F.col("base")))
    piece = F.struct("b", F.when(F.col("b") < F.col("base"), F.col("t")).otherwise(F.substring("t", F.lit(1), (F.col("context_end") - F.col("b")).cast("int"))).alias("x"))
    target = F.substring("text", (F.col("context_end") - F.col("base") + 1).cast("int"), (F.col("loss_end") - F.col("context_end") + len(END)).cast("int"))
    loss = F.substring("text", (F.col("loss_start") - F.col("base") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return joined.groupBy("conv_id", "loss_start", target.alias("target"), loss.alias("loss_text")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["x"]), "").alias("context")
    )


def read_back(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Digests of conversations: turns from their stored pages by the template, replies from their examples by the loss mask."""
    parts = F.split("text", END, -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    pattern = r"(?s)^### ((?:[^\\:]|\\.)*): (.*)$"
    turns = F.transform(parts, lambda p: F.concat(unescape(F.regexp_extract(p, pattern, 1)), F.lit("\n"), unescape(F.regexp_extract(p, pattern, 2)), F.lit("\n")))
    page = pages.select("conv_id", "page", F.size(parts).cast("bigint").alias("n"), F.array_join(turns, "").alias("turns"), F.length("text").cast("bigint").alias("chars"))
    whole = page.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("page", "turns"))).alias("pages"))
    loss = unescape(F.substring("target", (F.col("loss_at") + 1).cast("int"), F.col("loss_chars").cast("int")))
    replies = found.select(F.col("conv_id").alias("of"), "context_end", loss.alias("loss"), (F.col("context_end") + F.length("target")).alias("chars")).groupBy("of").agg(
        F.count(F.lit(1)).alias("n_examples"), F.sum("chars").alias("example_chars"), F.array_sort(F.collect_list(F.struct("context_end", "loss"))).alias("replies")
    )
    joined = lambda rows, field: F.coalesce(F.array_join(F.transform(rows, lambda p: p[field]), ""), F.lit(""))
    zero = F.lit(0).cast("bigint")
    return whole.join(replies, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", "n_turns", F.sha2(joined("pages", "turns"), 256).alias("turns_sha256"), F.length(joined("replies", "loss")).cast("bigint").alias("loss_chars"),
        F.sha2(joined("replies", "loss"), 256).alias("loss_sha256"), "formatted_chars", F.coalesce("n_examples", zero).alias("n_examples"), F.coalesce("example_chars", zero).alias("example_chars"),
    )
