"""Chat formatting: turns to one marked string per conversation, and back, in Spark expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.exprs import let

# The template's marks, and control strings of common chat templates.
START, BODY, JOIN, END = "<|turn|>", "<|body|>", "<|join|>", "<|end|>"
CONTROL = (START, BODY, JOIN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

_BREAK = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    """Double every backslash, then put one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, "\\\\")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss_mask``.

    The turns of a conversation are collected as structs, sorted by (turn, role, text) and put
    together as ``<|turn|>role<|body|>text<|end|>``; neighbours with the same role share one
    mark and are parted by ``<|join|>``. ``loss_mask`` is a run-length list of
    (chars, loss) over the code points of ``formatted``: true over the texts of ``loss_roles``.

    Null role and null text become empty; empty texts, repeated rows and equal turn numbers
    keep their own segment (order then by role and text); rows with a null conversation form one
    conversation; other columns are ignored; an empty table gives an empty table. One
    conversation is one string and so has to fit one row; conversations are otherwise independent.
    """
    rows = df.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x")).alias("_s"),
    )
    g = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_s")).alias("_a"))
    # each turn with its neighbours' roles: merging is a comparison, so the work stays linear
    near = g.select("_c", F.transform("_a", lambda s, i: F.struct(s["r"].alias("r"), escape(s["x"]).alias("x"), F.coalesce(F.get(F.col("_a"), i - 1)["r"] == s["r"], F.lit(False)).alias("same"), F.coalesce(F.get(F.col("_a"), i + 1)["r"] == s["r"], F.lit(False)).alias("more"))).alias("_m"))
    parts = near.select("_c", F.transform("_m", lambda m: F.struct(
        F.when(m["same"], F.lit(JOIN)).otherwise(F.concat(F.lit(START), escape(m["r"]), F.lit(BODY))).alias("head"),
        m["x"].alias("x"), F.when(m["more"], F.lit("")).otherwise(F.lit(END)).alias("tail"), m["r"].isin(*loss_roles).alias("loss"))).alias("_p"))
    return parts.select(
        F.col("_c").alias(conv),
        F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["x"], p["tail"])), "").alias("formatted"),
        F.flatten(F.transform("_p", lambda p: F.array(
            F.struct(F.length(p["head"]).alias("chars"), F.lit(False).alias("loss")),
            F.struct(F.length(p["x"]).alias("chars"), p["loss"].alias("loss")),
            F.struct(F.length(p["tail"]).alias("chars"), F.lit(False).alias("loss"))))).alias("loss_mask"),
    )


def read_chats(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """All columns of ``df`` and ``turns``: the (role, text) pairs read back from ``formatted``.

    Null gives null, an empty string no turns.
    """
    blocks = F.filter(F.split(F.col(formatted), re.escape(END)), lambda b: b != F.lit(""))
    cut = F.transform(blocks, lambda b: F.split(F.replace(b, F.lit(START), F.lit("")), re.escape(BODY), 2))
    turns = F.flatten(F.transform(cut, lambda c: F.transform(F.split(c[1], re.escape(JOIN)), lambda x: F.struct(unescape(c[0]).alias("role"), unescape(x).alias("text")))))
    return df.withColumn("turns", turns)


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """The text under the true runs of ``loss_mask``, each run unescaped, joined.

    Runs are cut from a form with four bytes per code point, and gathered by 256, so the work
    stays linear in the length of the conversation.
    """
    # decoding takes a leading U+FEFF for a byte order mark, so each run is decoded behind another character
    first = F.encode(F.lit("x"), "UTF-32")
    text = lambda run: unescape(F.substring(F.decode(F.concat(first, run), "UTF-32"), 2, 2**31 - 1))

    def cut(wide: Column) -> Column:
        start = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("said"))

        def step(acc: Column, m: Column) -> Column:
            run = text(F.substring(wide, 4 * acc["at"] + 1, 4 * m["chars"]))
            return F.struct((acc["at"] + m["chars"]).alias("at"), F.when(m["loss"], F.array_append(acc["said"], run)).otherwise(acc["said"]).alias("said"))

        def many(acc: Column, part: Column) -> Column:
            done = lambda inner: F.struct(inner["at"].alias("at"), F.array_append(acc["said"], F.array_join(inner["said"], "")).alias("said"))
            return F.aggregate(part, start(acc["at"]), step, done)

        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(loss_mask) / 256).cast("int")), lambda i: F.slice(loss_mask, i * 256 + 1, 256))
        return F.aggregate(parts, start(F.lit(0)), many, lambda acc: F.array_join(acc["said"], ""))

    return let(F.encode(formatted, "UTF-32"), cut)
