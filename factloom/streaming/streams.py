"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.graph import derived_closure
from factloom.operators.policy import apply_policy
from factloom.sources.readers import normalize_changes

#: Structural fields of a change row that an audit may keep.
AUDIT_FIELDS = ("id", "status", "entityId", "predicate", "recordedAt", "retractedAt", "supersededBy")


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def redact_changes(changes: DataFrame) -> DataFrame:
    """Only the structural fields of the row stay."""
    kept = F.to_json(F.struct(*(F.get_json_object("row", f"$.{f}").alias(f) for f in AUDIT_FIELDS)))
    return changes.withColumn("row", kept)


def audit_stream(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Normalised and redacted changes (source, version, at and the item's columns), each (source, record, version) once."""
    items = changes.select("source", "at", "version", *(F.col(c) for c in ("create", "update", "current", "delete")))
    made = normalize_changes(items.withColumn("version", F.struct("version", "source", "at")))
    flat = made.select("op", "record_id", "row", "version.version", "version.source", "version.at")
    return redact_changes(flat).withWatermark("at", delay).dropDuplicatesWithinWatermark(["source", "record_id", "version"])


def stats_stream(changes: DataFrame) -> DataFrame:
    """status, n from signed changes (status, delta: +1 or -1); for update or complete mode."""
    return changes.groupBy("status").agg(F.sum("delta").alias("n"))


def session_stream(turns: DataFrame, gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """conversation_id, start, last, n of sessions of turns; a turn exactly the gap later is in the session."""
    return (
        turns.withWatermark("occurred_at", late)
        .groupBy("conversation_id", F.session_window("occurred_at", gap).alias("s"))
        .agg(F.count("*").alias("n"), F.max("occurred_at").alias("last"))
        .select("conversation_id", F.col("s.start").alias("start"), "last", "n")
    )


def live_facts(facts: DataFrame, registry: DataFrame, sets: list[dict], scopes: list[str], delay: str = "1 hour") -> DataFrame:
    """Facts that the scopes and policies let through, each fact_id once."""
    closed = registry.where(F.col("requires_scope").isNotNull() & ~F.coalesce(F.col("requires_scope").isin(*scopes), F.lit(False))).select("predicate", F.lit(True).alias("closed"))
    seen = facts.join(closed, "predicate", "left").where("closed IS NULL").drop("closed")
    allowed = apply_policy(seen, sets).where("decision <> 'deny'")
    return allowed.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["fact_id"])


def stale_batches(links: Callable[[], DataFrame], sink: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: facts that turn superseded or retracted in the live world mark all that derives from them."""

    def run(batch: DataFrame, number: int) -> None:
        turned = batch.where("derived_version IS NULL AND status IN ('superseded', 'retracted')").select("fact_id")
        derived_closure(links(), turned).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return run


def episodes_available(turns: DataFrame) -> DataFrame:
    """Metadata of new turns only."""
    return turns.select("turn_id", "conversation_id", "occurred_at", "user_id")
