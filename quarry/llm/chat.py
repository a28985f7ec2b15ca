"""Chat formatting with Spark expressions only.

Template: a block for each run of same-role turns, `<|im_start|>role<|im_sep|>text<|im_end|>`, with `<|im_turn|>`
between the texts of merged turns, so that no turn's bounds are lost. Control strings inside roles
and texts (this template's, and those of common others, see CONTROL) get one backslash behind their
first character; those that have backslashes there get one more. Taking one away again restores every
text, whatever it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"

#: What follows the first character of the control strings `<|`, `<s>`, `</s>`, `[INST]`, `[/INST]`.
CONTROL = r"(\||/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){CONTROL}", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){CONTROL}", r"$1$2$3")


def format_chat(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv, n_turns, n_blocks, formatted, segments) for every conversation of rows.

    segments is an array of (text, loss) structs whose texts, joined, are `formatted`; loss marks
    the texts of loss_role, without markers. Turns are sorted by (turn, role, text): ties have one
    order, repeated rows stay. A null text or role is empty, a null turn comes first, null
    conversation keys are one conversation; an empty table gives no rows. Other columns are ignored.

    The shuffle moves each turn once; a conversation has to be one row of the output, so its turns meet in
    one task, as an array that is walked linearly (neighbours by index, no growing accumulator copies).
    """
    turns = rows.select(
        F.col(conv).alias("__conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("__turn"),
    )
    sorted_ = turns.groupBy("__conv").agg(F.array_sort(F.collect_list("__turn")).alias("t"))
    n = F.size("t")

    def opens(i: Column) -> Column:
        return (i == 0) | (F.col("t")[F.greatest(i - 1, F.lit(0))]["role"] != F.col("t")[i]["role"])

    def closes(i: Column) -> Column:
        return (i == n - 1) | (F.col("t")[F.least(i + 1, n - 1)]["role"] != F.col("t")[i]["role"])

    def pieces(x: Column, i: Column) -> Column:
        i = i.cast("int")
        head = F.when(opens(i), F.concat(F.lit(START), escaped(x["role"]), F.lit(SEP))).otherwise(F.lit(TURN))
        tail = F.when(closes(i), F.lit(END)).otherwise(F.lit(""))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"]).alias("text"), (x["role"] == loss_role).alias("loss")),
            F.struct(tail.alias("text"), F.lit(False).alias("loss")),
        )

    out = sorted_.withColumn("segments", F.filter(F.flatten(F.transform("t", pieces)), lambda s: s["text"] != ""))
    starts = F.aggregate(
        F.transform("t", lambda x, i: opens(i.cast("int")).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return out.select(
        F.col("__conv").alias(conv),
        n.cast("long").alias("n_turns"),
        starts.alias("n_blocks"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, read back from the string alone."""
    block = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        body = F.regexp_replace(b, r"<\|im_end\|>$", "")
        role = F.split(body, r"<\|im_sep\|>", 2)[0]
        texts = F.split(F.split(body, r"<\|im_sep\|>", 2)[1], r"<\|im_turn\|>")
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(block, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
