"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted; neighbours of one role share a block:

    <|im_start|>role NEWLINE text [<|im_sep|>text ...]<|im_end|>NEWLINE

``<|im_sep|>`` stands between merged turns, so reading back gives every turn. Inside texts and roles
no ``<|`` is left: each run ``<``, some backslashes, ``|`` gets one backslash more, and loses it on
the way back. A line end in a role is written ``<|nl|>``. The loss mask covers the texts of
assistant turns: spans of code points in the formatted string, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import running_sums

# markers of the format (fixed values)
START, SEP, END, LINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): loss is an array of (start, end).

    Null roles and texts count as empty; null turn numbers come first; rows that tie on the turn number
    are ordered by role and text, repeated rows stay; a null key is a conversation of its own;
    an empty table gives no rows. One shuffle, by key. A conversation is one row of the result, so
    its turns meet in one task; no other conversation does."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    size = F.size("ts")
    head = lambda r: F.concat(F.lit(START), F.regexp_replace(escaped(r), "\n", LINE), F.lit("\n"))

    def before(t: Column, i: Column) -> Column:
        """What stands between the turn before and this one's text."""
        same = F.get("ts", i - 1)["role"] == t["role"]
        return F.when(i == 0, head(t["role"])).when(same, F.lit(SEP)).otherwise(F.concat(F.lit(END + "\n"), head(t["role"])))

    parts = chats.withColumn("parts", F.transform("ts", lambda t, i: F.struct(before(t, i).alias("mark"), escaped(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss"))))
    lengths = F.flatten(F.transform("parts", lambda p: F.array(F.length(p["mark"]).cast("long"), F.length(p["body"]).cast("long"))))
    placed = parts.withColumn("at", running_sums(lengths))
    spans = F.transform("parts", lambda p, i: F.struct(F.get("at", 2 * i + 1).alias("start"), F.get("at", 2 * i + 2).alias("end"), p["loss"].alias("loss")))
    formatted = F.when(size > 0, F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END + "\n"))).otherwise("")
    return placed.select("conv_id", formatted.alias("formatted"), F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["end"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"\Q" + START + r"\E", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescaped(F.replace(F.substring_index(block, "\n", 1), F.lit(LINE), F.lit("\n")))
        body = F.substr(block, F.instr(block, "\n") + 1)
        body = F.substr(body, F.lit(1), F.length(body) - len(END) - 1)
        return F.transform(F.split(body, r"\Q" + SEP + r"\E", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, as an array with one text a span."""
    return F.transform(loss, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def chat_digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, read back from ``format_chats``' output."""
    read = chats.withColumn("ts", read_turns(F.col("formatted"))).withColumn("said", F.array_join(read_loss(F.col("formatted"), F.col("loss")), ""))
    told = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
