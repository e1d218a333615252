"""Chat formatting by event sourcing: fold each conversation's log into its final messages, then render them.

The log has one event per row: conv_id, seq, turn, kind, role, text. ``delta`` appends its text to the turn's
message, ``edit`` replaces the message by its text, ``regenerate`` withdraws the turn's message and all later
turns, and starts the turn anew with its text. Folding needs no loop: within a conversation sorted by
sequence, an event counts unless a later event of its turn is an edit, or a later regeneration names its turn
or an earlier one. The events that count are concatenated per turn and rendered in turn order.

Defined results
* A null or unknown kind is a delta. A null text is the empty text; a null role is ``unknown``. A message's
  role is that of its last counting event.
* Events are ordered by seq (nulls first), then turn, kind, role and text. Repeated events apply once.
* A null turn is a message of its own before all others; a null conv_id is a conversation of its own.
* Empty and very long texts are ordinary. An empty log gives an empty result. Extra columns are ignored.
* A marker of the format inside a text is defused by a backslash after its first character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

START, END = "<|im_start|>", "<|im_end|>"
_FIELDS = ("conv_id", "seq", "turn", "kind", "role", "text")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of each conversation.

    One shuffle, by conversation, serves the whole fold; none if the log is partitioned so already.
    """
    log = events.select([col(events, c).alias(c) for c in _FIELDS]).distinct()
    log = log.withColumn("kind", F.when(F.col("kind").isin("edit", "regenerate"), F.col("kind")).otherwise("delta"))
    order = [F.col("seq").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("kind"), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    log = log.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    level = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)))
    log = log.withColumn("level", level)
    withdrawn = F.min(F.when(F.col("kind") == "regenerate", F.col("level"))).over(later)
    log = log.withColumn("gone", F.coalesce(withdrawn <= F.col("level"), F.lit(False))).filter("not gone")
    turn = Window.partitionBy("conv_id", "turn")
    log = log.withColumn("edited", F.max(F.when(F.col("kind") == "edit", F.col("at"))).over(turn)).filter("edited is null or at >= edited")
    parts = F.sort_array(F.collect_list(F.struct("at", F.coalesce("text", F.lit("")).alias("text"))))
    return log.groupBy("conv_id", "turn").agg(F.max_by(F.coalesce("role", F.lit("unknown")), "at").alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def render(final: DataFrame) -> DataFrame:
    """conv_id, n_messages and text: each conversation's messages between markers, in turn order."""
    safe = F.replace(F.replace(F.col("text"), F.lit(START), F.lit("<\\|im_start|>")), F.lit(END), F.lit("<\\|im_end|>"))
    one = F.concat(F.lit(START), F.col("role"), F.lit("\n"), safe, F.lit(END + "\n"))
    rows = F.sort_array(F.collect_list(F.struct("turn", one.alias("text"))))
    return final.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log that ends in a table of turns, with every kind of event.

    By a hash of conversation and turn, half of the messages are streamed line by line, as deltas. A quarter is first
    streamed up to its middle and then edited into the whole; another quarter likewise, but regenerated, after the next
    turn had begun to answer the draft. Where a conversation has several rows for a turn, the first in order of role and
    text is treated so and each later one is an edit of it.
    """
    t = conversations.select([col(conversations, c).alias(c) for c in ("conv_id", "turn", "role", "text")]).repartition("conv_id").distinct()
    w = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    t = t.withColumn("version", F.row_number().over(w)).withColumn("text", F.coalesce("text", F.lit("")))
    draft = F.expr("left(text, length(text) div 2)")
    way = F.when(F.col("version") > 1, 4).when(F.col("turn").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)).cast("int"))

    def event(kind: str, text: Column, turn: Column | str = "turn") -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col(turn) if isinstance(turn, str) else turn).alias("turn"), text.alias("text"))

    streamed = F.transform(F.split("text", "(?<=\n)", -1), lambda line: event("delta", line))
    edited = F.array(event("delta", draft), event("edit", F.col("text")))
    renewed = F.array(event("delta", draft), event("delta", F.lit("?"), F.col("turn") + 1), event("regenerate", F.col("text")))
    events = F.when(way == 4, F.array(event("edit", F.col("text")))).when(way == 1, edited).when(way == 3, renewed).otherwise(streamed)
    parts = t.select("conv_id", F.col("turn").alias("of"), "role", "version", F.posexplode(events).alias("at", "e"))
    seq = F.coalesce(F.col("of").cast("long"), F.lit(-1)) * (1 << 36) + (F.col("version") - 1) * (1 << 28) + F.col("at")
    return parts.select("conv_id", seq.alias("seq"), F.col("e.turn").alias("turn"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_messages, text: every conversation of a table of turns, rebuilt from its log and rendered."""
    return render(messages(log_of(conversations)))
