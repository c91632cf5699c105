"""Chat conversations as training examples: one for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import text_or_empty

#: The template's control strings. An escaped text holds neither.
HEAD, END = "###", "</turn>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """Text without control strings, reversibly: a backslash always stands before the character it protects."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(HEAD), F.lit("\\#\\#\\#"))
    return F.replace(out, F.lit(END), F.lit("<\\/turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_examples(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep_rest: bool = True
) -> DataFrame:
    """(conv, example, last, formatted, loss_start, loss_end): an example for each assistant turn.

    ``formatted`` holds all turns up to that reply; only the reply's escaped text, from
    code point ``loss_start`` up to ``loss_end``, is trained on. Turns that no reply
    follows come as a last example without loss (start and end at its end), unless
    ``keep_rest`` is false. A turn is written ``### role: text</turn>`` and a line feed.

    Null roles and texts are empty; rows with the same turn number go by role and text,
    null turn numbers first; repeated rows are repeated turns; a null conversation id is
    a conversation. An empty table gives no rows. Other columns are not read.

    Examples are made row by row from the turns of a conversation, so a task holds one
    conversation and one example at a time, not all its examples.
    """
    said = F.struct(F.col(turn).alias("n"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text"))
    talks = turns.select(F.col(conv).alias("conv"), said.alias("said")).groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("said"))
    talks = talks.select(
        "conv",
        F.transform("said", lambda s: F.struct(
            (s["role"] == ASSISTANT).alias("reply"),
            F.concat(F.lit(f"{HEAD} "), escape_role(s["role"]), F.lit(": ")).alias("head"),
            escape(s["text"]).alias("body"),
        )).alias("said"),
        F.size("said").alias("n"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("said", i)["reply"] | (F.lit(keep_rest) & (i == F.col("n"))))
    one = talks.select("conv", "said", "n", F.posexplode(ends).alias("example", "end"))
    line = lambda s: F.concat(s["head"], s["body"], F.lit(f"{END}\n"))
    before = F.array_join(F.transform(F.slice("said", F.lit(1), F.col("end") - 1), line), "")
    final = F.element_at("said", F.col("end"))
    whole = one.select(
        F.col("conv").alias(conv), F.col("example").cast("long").alias("example"), (F.col("end") == F.col("n")).alias("last"),
        final["reply"].alias("reply"), final["head"].alias("head"), final["body"].alias("body"), before.alias("before"),
    )
    formatted = F.concat("before", "head", "body", F.lit(f"{END}\n"))
    start = F.length("before") + F.length("head")
    return whole.select(
        conv, "example", "last", formatted.alias("formatted"),
        F.when(F.col("reply"), start).otherwise(F.length(formatted)).alias("loss_start"),
        F.when(F.col("reply"), start + F.length("body")).otherwise(F.length(formatted)).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    lines = F.split(formatted, f"{END}\n", -1)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)
    head = rf"(?s)^{HEAD} ((?:[^\\:]++|\\.)*+): (.*)$"
    return F.transform(lines, lambda x: F.struct(
        unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")
    ))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What is trained on, as it was said."""
    return unescape(F.substring(formatted, start + 1, end - start))
