"""Scope, world, language, attribute and quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPOSER = "aggregate-composer-v1"


def user_scope(df: DataFrame, user: str | None, column: str = "user_id") -> DataFrame:
    """Without a user only shared rows, else shared and own rows."""
    shared = F.col(column).isNull()
    return df.where(shared if user is None else shared | (F.col(column) == user))


def world_fence(df: DataFrame, versions: list[str | None]) -> DataFrame:
    """Rows of the given derived worlds; None is the live world."""
    named = [v for v in versions if v is not None]
    wanted = F.col("derived_version").isin(*named) if named else F.lit(False)
    return df.where(wanted | F.col("derived_version").isNull() if None in versions else wanted)


def live_version(registry: DataFrame) -> DataFrame:
    """The version that the registry's row `facts` marks live, for a join with facts."""
    return registry.where("name = 'facts' AND status = 'live'").select("version")


def lang_backoff(hits: DataFrame, lang: str, k: int) -> DataFrame:
    """Per query the hits in lang or without one; where they are fewer than k / 2, all hits, the first kind first.

    hits has query_id, fact_id, score; the result adds pass (1 or 2).
    """
    own = hits.where((F.col("lang") == lang) | F.col("lang").isNull()).withColumn("pass", F.lit(1))
    enough = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k / 2).select("query_id")
    more = hits.join(enough, "query_id", "left_anti").withColumn("pass", F.lit(2))
    first = F.row_number().over(W.partitionBy("query_id", "fact_id").orderBy("pass"))
    return own.unionByName(more).withColumn("__n", first).where("__n = 1").drop("__n")


def attribute_filters(
    facts: DataFrame,
    min_confidence: float | None = None,
    predicates: list[str] | None = None,
    entity_ids: list[str] | None = None,
    prefix: str | None = None,
    types: list[str] | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """facts that pass every filter that is given; types are those of their entities (entity_id, type)."""
    out = facts
    if types:
        out = out.join(entities.where(F.col("type").isin(*types)).select("entity_id"), "entity_id", "left_semi").select(*facts.columns)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if predicates:
        out = out.where(F.col("predicate").isin(*predicates))
    if entity_ids:
        out = out.where(F.col("entity_id").isin(*entity_ids))
    return out.where(F.col("predicate").startswith(prefix)) if prefix else out


def only_atomic(facts: DataFrame) -> DataFrame:
    """Without summaries and composed rows."""
    return facts.where(~F.col("predicate").startswith("summary_") & ~F.col("recorder").eqNullSafe(COMPOSER))


def require_provenance(facts: DataFrame) -> DataFrame:
    return facts.where("vertical IS NOT NULL OR recorder IS NOT NULL OR origin_key IS NOT NULL")


def edge_fence(edges: DataFrame, user: str | None, moment: Column | None = None) -> DataFrame:
    """Edges in scope that are live, or were at a moment."""
    mine = user_scope(edges, user)
    if moment is None:
        return mine.where("invalidated_at IS NULL")
    return mine.where((F.col("created_at") <= moment) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > moment)))


def scope_gate(facts: DataFrame, registry: DataFrame, scopes: list[str]) -> DataFrame:
    """Without facts whose predicate needs a scope that the caller lacks. The registry is a dimension of a few rows."""
    need = F.col("requires_scope")
    closed = registry.where(need.isNotNull() & (~need.isin(*scopes) if scopes else F.lit(True))).select("predicate")
    return facts.join(closed, "predicate", "left_anti").select(*facts.columns)


def quality_floor(hits: DataFrame, min_confidence: float, min_trust: float) -> DataFrame:
    """Without facts below either floor; calibrated confidence falls back to confidence, reputation to 0.5."""
    return hits.where(
        (F.coalesce("calibrated_confidence", "confidence") >= min_confidence)
        & (F.coalesce("reputation", F.lit(0.5)) >= min_trust)
    )


def coverage(hits: DataFrame, min_score: float, min_facts: int) -> DataFrame:
    """Per query: top_score, n_facts, covered."""
    return hits.groupBy("query_id").agg(F.max("score").alias("top_score"), F.count(F.lit(1)).alias("n_facts")).withColumn(
        "covered", (F.col("top_score") >= min_score) & (F.col("n_facts") >= min_facts)
    )
