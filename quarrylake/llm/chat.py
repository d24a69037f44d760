"""Chat formatting from an event log.

``fold_events`` rebuilds conversations from events (conv_id, seq, msg, event,
role, text): ``message`` sets a message, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` discards it together with all later messages
of the conversation (what follows writes them anew).  Events are partitioned by
conversation and sorted by seq; windows find what later events discard, and what
is left of each message is concatenated in order.

``render`` writes a conversation as segments of one string, each under the loss
mask or not.  Turn marks are control strings; inside roles and texts a backslash
is doubled and put after the first character of every control string, so that no
control string is left and reading back is exact.  ``read_back`` parses the
rendered string, ``read_loss`` the masked segments.

A conversation becomes one row, so its turns meet in one task by definition;
nothing else is gathered.  Everything is a Spark SQL expression.

Defined cases: a null text or role is empty; a null conv_id is a conversation of
its own; ties of seq are ordered by msg, event, role and text; repeated events
are applied once each; an empty log gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Marks of this template, then control strings of other common templates.
START, MIDDLE, STOP = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log."""
    # from the last event back, so that what later events say is a running value
    order = [F.desc(c) for c in ("seq", "msg", "event", "role", "text")]
    later = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    back = F.when(F.col("event") == "regenerate", F.col("msg"))
    kept = events.withColumn("cut", F.min(back).over(later)).where("event <> 'regenerate' and (cut is null or msg < cut)").drop("cut")
    same = Window.partitionBy("conv_id", "msg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reset = F.when(F.col("event").isin("message", "edit"), F.lit(1))
    kept = kept.withColumn("again", F.max(reset).over(same)).where("again is null").drop("again")
    parts = F.array_sort(F.collect_list(F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role")))
    return (
        kept.groupBy("conv_id", "msg")
        .agg(parts.alias("parts"))
        .select(
            "conv_id",
            "msg",
            F.coalesce(F.array_max(F.transform("parts", lambda p: p["role"])), F.lit("")).alias("role"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        )
    )


def as_events(turns: DataFrame) -> DataFrame:
    """An event log whose folding gives ``turns`` (conv_id, msg, role, text) back: every
    text arrives in two parts; one turn in three was edited from another text, one in
    three was discarded once and written anew."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    streamed = [event("message", first), event("delta", rest)]
    edited = [event("message", rest), event("delta", first), event("edit", F.col("text"))]
    again = [event("message", rest), event("delta", F.col("text")), event("regenerate", F.lit(None).cast("string")), *streamed]
    way = F.pmod(F.xxhash64("conv_id", "msg"), F.lit(3))
    log = F.when(way == 0, F.array(*streamed)).when(way == 1, F.array(*edited)).otherwise(F.array(*again))
    rows = turns.select("conv_id", "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "msg", "role", F.posexplode(log).alias("at", "e"))
    return rows.select("conv_id", (F.col("msg").cast("long") * 8 + F.col("at")).alias("seq"), "msg", "e.event", "role", "e.text")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``segments``, whose texts joined are the formatted
    string and of which those with ``loss`` are learnt."""
    turn = F.struct("msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    one = lambda t: F.array(
        segment(F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE)), F.lit(False)),
        segment(escape(t["text"]), t["role"] == learn),
        segment(F.lit(STOP), F.lit(False)),
    )
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.flatten(F.transform("turns", one)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted string."""
    pieces = F.split(text, r"\Q" + STOP + r"\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(len(START) + 1), F.instr(p, MIDDLE) - 1 - len(START))).alias("role"),
            unescape(F.substring(p, F.instr(p, MIDDLE) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
