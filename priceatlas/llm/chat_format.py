"""Chat formatting by event-sourced reconstruction: logs are folded into final messages, then rendered (DataFrame functions only).

Events of a message, in the order of seq: `message` opens it and carries its role, `delta` appends text, `edit` replaces the text
so far, `regenerate` discards it. Template: <turn ROLE>\\nTEXT</turn>\\n with &, < and > of role and text written as &amp; &lt; &gt;,
so no text can hold a marker and the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a streamed delta.
DELTA = 2048
#: Turns that are rendered together before conversations are joined up.
TURN_BLOCK = 64
END = "</turn>\n"


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def events_of(turns: DataFrame) -> DataFrame:
    """The event log of finished conversations: each row opens a message and streams its text as deltas. Null text: empty; null role: empty."""
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), pieces.alias("p")).withColumn("message_id", F.monotonically_increasing_id())
    logged = rows.select("conv_id", "turn", "message_id", "role", F.posexplode(F.concat(F.array(F.lit("")), "p")).alias("seq", "text"))
    return logged.withColumn("kind", F.when(F.col("seq") == 0, "message").otherwise("delta"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, message_id, role, text: the final messages. Events of one seq fold in the order of (kind, text); a null seq comes first."""
    log = F.sort_array(F.collect_list(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "kind", F.coalesce("text", F.lit("")).alias("text"))))
    folded = events.groupBy("conv_id", "turn", "message_id").agg(F.max(F.when(F.col("kind") == "message", F.col("role"))).alias("role"), log.alias("log"))
    starts = F.transform(F.filter("log", lambda e: e.kind.isin("message", "edit", "regenerate")), lambda e: e.seq)
    folded = folded.withColumn("start", F.coalesce(F.array_max(starts), F.lit(-1)))
    live = F.filter("log", lambda e: (e.seq >= F.col("start")) & (e.kind != "regenerate"))
    return folded.select("conv_id", "turn", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e.text), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_mask: one row per conversation.

    loss_mask has a struct(start, length) per turn, in code points of that turn's own segment: its text if the role is loss_role, else
    length 0. Turns are in the order of (turn, role, text), null turns first. Blocks of turns are joined first, so that a conversation
    with very many turns is put together from few rows; its text is one value in the end, as the format asks.
    """
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"))
    bears = F.col("role") == loss_role

    def segment(x: Column) -> Column:
        body = escape(x.text)
        mask = F.struct(F.length(x.head).alias("start"), F.when(x.bears, F.length(body)).otherwise(0).alias("length"))
        return F.struct(F.concat(x.head, body, F.lit(END)).alias("segment"), mask.alias("mask"))

    turn = F.struct("turn", "role", "text", "message_id", head.alias("head"), bears.alias("bears"))  # ties go by the plain text, which is escaped afterwards
    blocks = messages.groupBy("conv_id", F.floor(F.col("turn") / TURN_BLOCK).alias("block")).agg(F.transform(F.sort_array(F.collect_list(turn)), segment).alias("t"))
    blocks = blocks.select("conv_id", F.struct("block", F.array_join(F.col("t.segment"), "").alias("text"), F.col("t.mask").alias("mask")).alias("b"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return whole.select("conv_id", F.array_join(F.col("b.text"), "").alias("formatted"), F.flatten(F.col("b.mask")).alias("loss_mask"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Event log -> formatted conversations (see reconstruct and render). Extra columns are ignored; an empty log gives no rows; a null conv_id is a conversation of its own."""
    return render(reconstruct(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, turns array<struct<role, text>>, loss array<string> (unescaped text under the mask, turn by turn), parsed from the output alone."""
    parts = F.split("formatted", END)
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(parts) - 1).alias("s"), F.col("loss_mask").alias("m"))

    def turn(x):
        head = F.substring_index(x.s, ">\n", 1)
        return F.struct(unescape(F.substring(head, F.lit(7), F.length(head))).alias("role"), unescape(F.substring(x.s, F.length(head) + 3, F.length(x.s))).alias("text"))

    return formatted.select(
        "conv_id", (F.size(parts) - 1).cast("long").alias("n_turns"), "formatted",
        F.transform(zipped, turn).alias("turns"),
        F.transform(zipped, lambda x: unescape(F.substring(x.s, x.m.start + 1, x.m.length))).alias("loss"),
    )
