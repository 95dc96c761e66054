"""Chat formatting with Spark expressions only.

A conversation is collected as turn structs, sorted, and adjacent turns of one role are merged by array
aggregation; each merged block is one header and its texts. The layout is

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>

with ``<|next|>`` between texts of merged turns, so that turns can be read back. Control strings inside roles
and texts are escaped: backslashes are doubled and a backslash goes after the first character of every
control string. Unescaping drops each backslash and keeps what follows it.

Scale: one shuffle by conversation, no Python. A conversation becomes one string, so its turns meet in one
task by definition; different conversations never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
# Starts of our own marks, and control strings of other templates.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (start, length in code points) under the loss mask.

    ``turns`` has conv_id, turn, role, text. Turns go by number (null first), then role, then text; repeated rows are
    separate turns. A null role or text is an empty one. Rows with a null conv_id form one conversation. The
    mask covers each text of the ``trained`` role, without marks. An empty table gives no rows; extra columns
    are not looked at.
    """
    blank = F.lit("")
    turn = F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    texts = "struct<role:string,texts:array<string>>"
    none = F.array().cast(f"array<{texts}>")

    def merge(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(escape(t["text"]))).alias("texts"))
        new = F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts")).cast(texts)
        same = last["role"].eqNullSafe(t["role"])
        return F.when(same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined.cast(texts)))).otherwise(F.concat(done, F.array(new)))

    blocks = chats.select("conv_id", F.aggregate("turns", none, merge).alias("blocks"))
    head = lambda b: F.concat(F.lit(TURN), escape(b["role"]), F.lit(TEXT))
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, i: F.struct(
        F.when(i == 0, head(b)).otherwise(F.lit(NEXT)).alias("before"), t.alias("text"),
        F.when(i == F.size(b["texts"]) - 1, END).otherwise("").alias("after"), (b["role"] == trained).alias("trained")))))
    out = blocks.select("conv_id", pieces.alias("pieces"))
    state = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"

    def place(done: Column, p: Column) -> Column:
        start, length = done["at"] + F.char_length(p["before"]), F.char_length(p["text"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        spans = F.when(p["trained"], F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((start + length + F.char_length(p["after"])).alias("at"), spans.alias("spans")).cast(state)

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
                      F.aggregate("pieces", begin, place)["spans"].alias("spans"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda b: b != "")
    parts = lambda b: F.split(F.regexp_replace(b, r"<\|end\|>$", ""), r"<\|text\|>", -1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(F.get(parts(b), F.lit(1)), r"<\|next\|>", -1), lambda t: F.struct(
        unescape(F.get(parts(b), F.lit(0))).alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
