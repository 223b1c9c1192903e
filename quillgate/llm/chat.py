"""Chat formatting from an event log.

A log row is (conv_id, seq, event, message, role, text). `message` opens a message with a text, `delta` appends to it,
`edit` replaces its text, `regenerate` drops what it had and starts over. Logs are partitioned by conversation and ordered by seq;
each message is folded from its last restart on, the messages are put in order and rendered.

Template: `<turn>role<text>text</turn>\\n` per turn, where `&` and `<` of roles and texts become `&amp;` and `&lt;`, so no control
string can stand inside a text and the original comes back exactly. The loss mask is a list, one entry a turn, of
(start, end) in code points from the turn's beginning, or null where nothing is learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import column

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"


def escape(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c):
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of events(conv_id, seq, event, message, role, text).

    The role is that of the last event that names one; nulls in text count as empty, in role as ''. Rows of equal seq go by event,
    then text. Events other than the four named start a message over, like `edit`. Messages are numbered as in the log;
    deltas are pre-aggregated per message, whose final text is one value whatever the number of conversations.
    """
    rows = events.select(
        "conv_id", "message", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.coalesce("event", F.lit("message")).alias("event"), F.col("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    message = Window.partitionBy("conv_id", "message")
    rows = rows.select(
        "*", F.max(F.when(F.col("event") != "delta", F.struct("seq", "event", "text"))).over(message).alias("from"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).over(message).alias("last_role"),
    )
    live = rows.where(F.col("from").isNull() | (F.struct("seq", "event", "text") >= F.col("from")))
    parts = F.array_sort(F.collect_list(F.struct("seq", "event", "text")))
    return live.groupBy("conv_id", "message").agg(
        F.coalesce(F.max("last_role"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation of messages(conv_id, message, role, text), in order of `message`.

    Messages of equal number go by role, then text. A conversation is one output value; its turns are gathered map-side first.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turn = F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))
    begin = F.length(role) + len(OPEN) + len(MIDDLE)
    loss = F.when(F.col("role") == learned, F.struct(begin.alias("start"), (begin + F.length(text)).alias("end")))
    ordered = F.array_sort(F.collect_list(F.struct("message", F.coalesce("role", F.lit("")).alias("role"), turn.alias("turn"), loss.alias("loss"))))
    return messages.groupBy("conv_id").agg(ordered.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), F.transform("turns", lambda t: t["loss"]).alias("loss")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, learned array<string>, formatted) parsed from the formatted text and its mask."""
    pieces = F.split("formatted", CLOSE)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    body = lambda t: F.substr(t, F.lit(len(OPEN) + 1))
    parsed = F.transform(pieces, lambda t: F.struct(
        unescape(F.substring_index(body(t), MIDDLE, 1)).alias("role"),
        unescape(F.substr(body(t), F.length(F.substring_index(body(t), MIDDLE, 1)) + len(MIDDLE) + 1)).alias("text"),
    ))
    learned = F.zip_with(pieces, "loss", lambda t, m: F.when(m.isNotNull(), unescape(F.substr(t, m["start"] + 1, m["end"] - m["start"]))))
    return formatted.select("conv_id", parsed.alias("turns"), F.filter(learned, lambda x: x.isNotNull()).alias("learned"), "formatted")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of conversations(conv_id, turn, role, text): each row a `message` event of its own.

    Rows go by turn (null first), then role and text; repeated rows are turns of their own. Null role: ''; null text: empty; rows of null conv_id form
    one conversation. An empty table gives an empty result; other columns are ignored.
    """
    rows = conversations.select(
        column(conversations, "conv_id", "bigint").alias("conv_id"), column(conversations, "turn", "bigint").alias("seq"), F.lit("message").alias("event"),
        F.coalesce(column(conversations, "role", "string"), F.lit("")).alias("role"), F.coalesce(column(conversations, "text", "string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    return render(fold_events(rows.withColumn("message", F.row_number().over(order))))
