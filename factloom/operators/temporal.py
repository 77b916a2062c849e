"""Filters and joins on valid time [valid_from, valid_until) and on transaction time; a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.intervals import covering_lookup

HIDDEN = ("compacted", "corroborating")


def at(moment: str | Column) -> Column:
    return F.expr(moment) if isinstance(moment, str) else moment


def covers(moment: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    return (F.col(start) <= moment) & (F.col(end).isNull() | (F.col(end) > moment))


def live(moment: Column) -> Column:
    """Not retracted at a moment and of a status that reads may show."""
    return (F.col("retracted_at").isNull() | (F.col("retracted_at") > moment)) & ~F.col("status").isin(*HIDDEN)


def current_facts(
    facts: DataFrame, now: str | Column, include_stale: bool = False, include_retracted: bool = False, include_contested: bool = False
) -> DataFrame:
    """What holds now. A superseded fact stays while its interval still covers now (its successor starts later)."""
    now, out = at(now), facts
    if not include_retracted:
        out = out.where(F.col("retracted_at").isNull())
    if not include_contested:
        out = out.where(F.col("status") != "competing")
    if not include_stale:
        out = out.where(
            covers(now) & ~F.col("status").isin(*HIDDEN) & ((F.col("status") != "superseded") | (F.col("valid_until") > now))
        )
    return out


def facts_as_of(facts: DataFrame, moment: str | Column) -> DataFrame:
    """What held at a moment by today's knowledge: recorded_at plays no part."""
    moment = at(moment)
    return facts.where(live(moment) & covers(moment))


def entity_facts_as_of(facts: DataFrame, moment: str | Column) -> DataFrame:
    """As facts_as_of, of facts that had been recorded by then."""
    return facts_as_of(facts, moment).where(F.col("recorded_at") <= at(moment))


def facts_believed_at(facts: DataFrame, tx: str | Column, moment: str | Column | None = None) -> DataFrame:
    """What was believed at tx about a moment (default tx): a successor recorded later hadn't closed the fact yet."""
    tx = at(tx)
    moment = tx if moment is None else at(moment)
    later = facts.select(F.col("fact_id").alias("__next"), F.col("recorded_at").alias("__next_at"))
    joined = facts.where((F.col("recorded_at") <= tx) & live(tx) & (F.col("valid_from") <= moment)).join(
        later, F.col("superseded_by") == F.col("__next"), "left"
    )
    unknown = F.col("__next_at") > tx
    end = F.when(unknown, F.col("prior_valid_until")).otherwise(F.col("valid_until"))
    known = F.col("superseded_by").isNull() | F.col("__next").isNotNull()
    return joined.where(known & (end.isNull() | (end > moment))).select(*facts.columns)


def overlap_boost_pool(facts: DataFrame, moment: str | Column) -> DataFrame:
    """Lifecycle gates only; distance in time is left to the score."""
    return facts.where(live(at(moment)))


def as_of_lookup(probes: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Each probe (keys, at) with the latest started fact that held at `at`, as facts_as_of says; null where none did.

    A fact that started later but has ended, or had been retracted by then, does not hide one that still covers `at`.
    """
    ended = F.least("valid_until", F.col("retracted_at").cast(facts.schema["valid_until"].dataType))
    shown = facts.where(~F.col("status").isin(*HIDDEN)).withColumns({"__until": F.col("valid_until"), "valid_until": ended})
    found = covering_lookup(probes, shown, keys, ["fact_id"])
    return found.withColumn("valid_until", F.col("__until")).drop("__until").select(*probes.columns, *(c for c in facts.columns if c not in keys))


def timeline(facts: DataFrame, slot: list[str]) -> DataFrame:
    """Facts of single-valued slots with valid_until set to the start of the slot's next fact."""
    return facts.withColumn("valid_until", F.lead("valid_from").over(W.partitionBy(*slot).orderBy("valid_from", "fact_id")))


def latest_per_key(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The newest fact per keys; ties go to the larger fact_id."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("valid_from"), F.desc("fact_id")))
    return facts.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def freshness(facts: DataFrame) -> DataFrame:
    """Per entity the latest moment recorded and the latest start."""
    return facts.groupBy("entity_id").agg(F.max("recorded_at").alias("last_recorded"), F.max("valid_from").alias("last_valid_from"))


def update_history(facts: DataFrame, depth: int = 8, shown: int = 3) -> DataFrame:
    """(fact_id, step, old_id, old_object) for predecessors that led to each unsuperseded fact, the latest first.

    Walks superseded_by backwards one step a join; at most `shown` of `depth` steps are kept.
    """
    old = facts.where("superseded_by IS NOT NULL").select(
        F.col("superseded_by").alias("__of"), F.col("fact_id").alias("old_id"), F.col("object").alias("old_object")
    )
    here = facts.where("superseded_by IS NULL").select("fact_id", F.col("fact_id").alias("__at"))
    steps = []
    for step in range(1, min(depth, shown) + 1):
        here = here.join(old, F.col("__at") == F.col("__of")).select("fact_id", F.lit(step).alias("step"), "old_id", "old_object")
        steps.append(here)
        here = here.select("fact_id", F.col("old_id").alias("__at"))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def entity_timeline(facts: DataFrame) -> DataFrame:
    """entity_id, at, event (recorded or retracted), fact_id."""
    events = F.array(
        F.struct(F.col("recorded_at").alias("at"), F.lit("recorded").alias("event")),
        F.struct(F.col("retracted_at").alias("at"), F.lit("retracted").alias("event")),
    )
    return facts.select("entity_id", "fact_id", F.explode(events).alias("e")).where("e.at IS NOT NULL").select(
        "entity_id", "e.at", "e.event", "fact_id"
    )
