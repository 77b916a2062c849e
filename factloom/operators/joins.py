"""Joins between facts, entities, edges, turns and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_refs(under: Column, over: Column) -> Column:
    """Two maps as one; where both have a key, `over` has its way. A null map is empty."""
    none = F.create_map().cast("map<string,string>")
    over = F.coalesce(over, none)
    return F.map_concat(F.map_filter(F.coalesce(under, none), lambda k, v: ~F.map_contains_key(over, k)), over)


def reattribute_merged(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts of merged entities under the survivor, with refs of both; without a survivor's row they drop out.

    entities: entity_id, merged_into, external_refs (a map, or external_ref, which stands under `ref`). The result adds refs;
    where both entities have a key, the merged one's stays, since that is what the fact came under.
    """
    held = F.col("external_refs") if "external_refs" in entities.columns else F.create_map(F.lit("ref"), "external_ref")
    refs = F.map_filter(held, lambda k, v: v.isNotNull())
    losers = entities.where("merged_into IS NOT NULL").select(F.col("entity_id").alias("__loser"), F.col("merged_into").alias("__into"), refs.alias("__loser_refs"))
    alive = entities.select(F.col("entity_id").alias("__alive"), refs.alias("__refs"))
    joined = facts.join(losers, F.col("entity_id") == F.col("__loser"), "left").withColumn("__target", F.coalesce("__into", "entity_id"))
    kept = joined.join(alive, F.col("__target") == F.col("__alive"), "left").where("__loser IS NULL OR __alive IS NOT NULL")
    columns = (F.col("__target").alias(c) if c == "entity_id" else F.col(c) for c in facts.columns)
    return kept.select(*columns, union_refs(F.col("__refs"), F.col("__loser_refs")).alias("refs"))


def ref_key(vertical: Column, ref: Column) -> Column:
    return F.replace(F.concat(vertical, F.lit("__"), ref), F.lit("."), F.lit("__"))


def resolve_refs(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows (vertical, id) with the entity_id of refs (key, entity_id); null if unknown."""
    return rows.withColumn("key", ref_key(F.col("vertical"), F.col("id"))).join(refs, "key", "left")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, peer, direction, weight of edges that leave or reach a seed (entity_id)."""
    s = seeds.select(F.col("entity_id").alias("seed"))
    out = edges.join(s, F.col("src") == F.col("seed")).select("seed", F.col("dst").alias("peer"), F.lit("out").alias("direction"), "weight")
    into = edges.join(s, F.col("dst") == F.col("seed")).select("seed", F.col("src").alias("peer"), F.lit("in").alias("direction"), "weight")
    return out.unionByName(into)


def provenance(facts: DataFrame, turns: DataFrame, cut: int = 600) -> DataFrame:
    """fact_id, seq (chronological), turn_id, text of the turns that ground each fact (episode_ids)."""
    cited = facts.select("fact_id", F.explode("episode_ids").alias("turn_id")).distinct()
    order = W.partitionBy("fact_id").orderBy("occurred_at", "turn_id")
    return cited.join(turns, "turn_id").select(
        "fact_id", F.row_number().over(order).alias("seq"), "turn_id", F.substring("text", 1, cut).alias("text")
    )


def origin_docs(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """fact_id, doc_id for facts whose origin_key is `doc:<hash>` of docs (hash, doc_id)."""
    keyed = facts.where(F.col("origin_key").startswith("doc:")).select("fact_id", F.expr("substring(origin_key, 5)").alias("hash"))
    return keyed.join(docs.select("hash", "doc_id"), "hash").select("fact_id", "doc_id")


def hydrate(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with their entity's type and canonical_name."""
    return facts.join(entities.select("entity_id", "type", "canonical_name"), "entity_id", "left")


def orphans(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Unmerged entities without an active fact."""
    return entities.where("merged_into IS NULL").join(facts.where("status = 'active'"), "entity_id", "left_anti")
