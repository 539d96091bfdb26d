r"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role share a
block of the output:

    ### role: text</part>next text of the same role</turn>\n

Inside texts the backslash and the control strings are escaped reversibly: \ as \b, ### as \h\h\h,
</turn> as \l/turn>, </part> as \l/part>; a role's colon is \c and its line end \n. The loss mask
is kept by segments: the output is the segments' texts one after another, and a segment counts for
the loss if it is an assistant's text.

Defined cases: null text or role is empty; turns sort by (turn, role, text) with nulls first, so
ties and repeated rows have one order; a null conv_id is a conversation of its own; an empty table
gives no rows; further columns are ignored. A conversation is one value of the output, so it must
fit a row (2 GB), however long its texts are; turns are grouped in runs of RUN turns first, so a
task gathers runs, not turns, of a hot conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = 256
LOSS_ROLE = "assistant"
TURN_END = "</turn>\n"
PART_END = "</part>"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("###", "\\h\\h\\h"), ("</turn>", "\\l/turn>"), ("</part>", "\\l/part>")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for coded, plain in (("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments(text, loss): one row a conversation."""
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    coded = lambda t: F.struct(t["turn"].alias("turn"), _role(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    runs = turns.groupBy("conv_id", F.floor(F.col("turn") / RUN).alias("run")).agg(F.transform(F.sort_array(F.collect_list(one)), coded).alias("turns"))
    whole = runs.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("run", "turns"))), lambda x: x["turns"]).alias("runs")).select("conv_id", F.flatten("runs").alias("turns"))
    # Struct of the turn and the role before it, so that each turn knows whether it opens a block.
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"]))
    paired = F.arrays_zip(F.col("turns").alias("t"), F.slice(before, 1, F.size("turns")).alias("last"))

    def pieces(x: Column) -> Column:
        t, last = x["t"], x["last"]
        mark = F.when(last.isNull(), F.concat(F.lit("### "), t["role"], F.lit(": "))).when(last == t["role"], PART_END).otherwise(F.concat(F.lit(TURN_END + "### "), t["role"], F.lit(": ")))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")), F.struct(t["text"].alias("text"), (t["role"] == LOSS_ROLE).alias("loss")))

    end = F.array(F.struct(F.lit(TURN_END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform("paired", pieces)), end)
    return (
        whole.withColumn("paired", paired)
        .select("conv_id", segments.alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, TURN_END), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, ":", 1)
        body = block.substr(F.length(role) + 3, F.length(block))
        return F.transform(F.split(body, PART_END), lambda t: F.struct(_plain_role(role.substr(F.lit(5), F.length(role))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    back = formatted.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
