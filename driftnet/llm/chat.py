"""Chat formatting by prefix-target expansion (operator 2); DataFrame functions only.

Each turn becomes ``<s>[INST] role [/INST]text</s>``. In roles and texts, ``&``, ``<`` and ``[`` are written as
``&amp;``, ``&lt;`` and ``&#91;``, so no text can hold a control string, and reading back is exact. Every assistant
turn gives an example: all turns before it as context, then that turn, whose text alone is under the loss mask. Turns
that no assistant turn follows make an example of their own with nothing to learn, so that the examples hold the whole conversation.

Defined cases: a null text or role counts as empty. Turns are ordered by turn (null first), then role, then
text; repeated turns stay. A null conv_id is a conversation of its own. Extra columns are ignored. An empty table gives an
empty result. An example grows with its conversation, as the method asks; a conversation is formatted in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ASSISTANT = "assistant"
OPEN, CLOSE, END = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for raw, safe in CONTROL:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(CONTROL):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start (from 0), loss_chars: an example for each assistant turn, and the rest."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    laid = turns.select("conv_id", "turn", "role", "text", (F.col("role") == ASSISTANT).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    whole = F.concat("head", "body", F.lit(END))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.select("conv_id", F.count(F.lit(1)).over(in_order).alias("k"), F.sum(F.length(whole)).over(in_order).alias("stop"), "learn", F.length("body").alias("n"), whole.alias("part"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "stop", "learn", "n", "part"))).alias("parts"))
    formatted = grouped.select("conv_id", "parts", F.array_join("parts.part", "").alias("whole"))
    targets = F.filter("parts", lambda p: p["learn"] | (p["k"] == F.size("parts")))
    x = F.transform(targets, lambda p: F.struct(p["stop"], F.when(p["learn"], p["n"]).otherwise(F.lit(0)).alias("n"), p["learn"]))
    each = formatted.select("conv_id", "whole", F.posexplode(x).alias("example", "x"))
    start = F.when(F.col("x.learn"), F.col("x.stop") - len(END) - F.col("x.n")).otherwise(F.col("x.stop"))
    return each.select("conv_id", "example", F.substring("whole", F.lit(1), F.col("x.stop").cast("int")).alias("text"), start.cast("long").alias("loss_start"), F.col("x.n").cast("long").alias("loss_chars"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    raw = F.slice(F.split(text, END), F.lit(1), F.size(F.split(text, END)) - 1)

    def turn(x: Column) -> Column:
        at = F.locate(CLOSE, x)
        role = F.substring(x, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, at + len(CLOSE), F.length(x))).alias("text"))

    return F.transform(raw, turn)


def digest(examples: DataFrame) -> DataFrame:
    """What the examples hold, by conversation, read back from their texts and loss masks."""
    learned = F.substring("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    grouped = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_sort(F.collect_list(F.struct("example", learned.alias("x")))).alias("learned"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    read = grouped.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("learned", lambda e: unescape(e["x"])), "").alias("loss"), "formatted_chars", "n_examples")
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
