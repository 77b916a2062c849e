"""Windows over conversation turns and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize(turns: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """turns with session (from 0): a new one starts when more than the gap has passed since the turn before."""
    order = W.partitionBy("conversation_id").orderBy("occurred_at", "turn_id")
    gap = F.unix_micros(F.col("occurred_at").cast("timestamp")) - F.unix_micros(F.lag("occurred_at").over(order).cast("timestamp"))
    starts = F.when(gap > gap_minutes * 60_000_000, 1).otherwise(0)
    return turns.withColumn("__starts", starts).withColumn("session", F.sum("__starts").over(order)).drop("__starts")


def segment_windows(turns: DataFrame, size: int = 4, stride: int = 2) -> DataFrame:
    """conversation_id, session, start, turn_ids, text: sliding windows of turns; the last one reaches the session's end.

    turns has session. A session no longer than `size` is one window.
    """
    per = W.partitionBy("conversation_id", "session")
    rows = turns.withColumn("__at", F.row_number().over(per.orderBy("occurred_at", "turn_id")) - 1).withColumn("__n", F.count(F.lit(1)).over(per))
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - size) / stride)) * stride
    first = F.greatest(F.lit(0), F.ceil((F.col("__at") - size + 1) / stride)) * stride
    latest = F.least(last, F.floor(F.col("__at") / stride) * stride)
    held = rows.where(first <= latest).withColumn("start", F.explode(F.sequence(first.cast("long"), latest.cast("long"), F.lit(stride).cast("long"))))
    members = F.array_sort(F.collect_list(F.struct("__at", "turn_id", "text")))
    return held.groupBy("conversation_id", "session", "start").agg(members.alias("m")).select(
        "conversation_id", "session", "start", F.transform("m", lambda x: x["turn_id"]).alias("turn_ids"),
        F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"),
    )


def best_mention_per_session(rows: DataFrame) -> DataFrame:
    """Of each (query_id, session_key) the row with the highest lexical score, then similarity, then smaller fact_id."""
    rank = F.row_number().over(W.partitionBy("query_id", "session_key").orderBy(F.desc("lexical"), F.desc("similarity"), "fact_id"))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def turn_context(turns: DataFrame, anchors: DataFrame, span: int) -> DataFrame:
    """Turns within `span` turns of an anchor (turn_id) of their conversation, each once."""
    order = W.partitionBy("conversation_id").orderBy("occurred_at", "turn_id")
    marked = turns.join(anchors.select("turn_id", F.lit(1).alias("__anchor")).distinct(), "turn_id", "left")
    near = F.max("__anchor").over(order.rowsBetween(-span, span))
    return marked.withColumn("__near", near).where("__near = 1").select(*turns.columns)


def event_gaps(dates: DataFrame, newest: int = 12) -> DataFrame:
    """Per entity its distinct days (newest ones): weekday, days since the day before. dates: entity_id, day."""
    days = dates.select("entity_id", F.to_date("day").alias("day")).distinct()
    order = W.partitionBy("entity_id").orderBy("day")
    rows = days.withColumn("gap", F.datediff("day", F.lag("day").over(order)).cast("long"))
    rank = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("day")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= newest).select("entity_id", F.col("day").cast("string").alias("day"), F.date_format("day", "EEEE").alias("weekday"), "gap")
