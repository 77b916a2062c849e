"""Diffs, erasure, retention and worlds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memory_diff(facts: DataFrame, entities: DataFrame, start: Column, stop: Column, forgotten: DataFrame | None = None) -> DataFrame:
    """section, id, replaced_by, before, after of what happened in [start, stop).

    changed: a fact whose successor was recorded then, with the successor and the objects of both; retracted; created: facts
    recorded then that are no such successors; new_entity: entities with created_at; forgotten: tombstones (hash, forgotten_at).
    """
    within = lambda c: (c >= start) & (c < stop)
    plain = lambda df, section, key: df.select(F.lit(section).alias("section"), F.col(key).alias("id"), *(F.lit(None).cast("string").alias(c) for c in ("replaced_by", "before", "after")))
    fresh = facts.where(within(F.col("recorded_at")))
    old = facts.where("superseded_by IS NOT NULL").select(F.col("fact_id").alias("old_id"), F.col("object").alias("before"), F.col("superseded_by").alias("fact_id"))
    changed = fresh.join(old, "fact_id").select(F.lit("changed").alias("section"), F.col("old_id").alias("id"), F.col("fact_id").alias("replaced_by"), "before", F.col("object").alias("after"))
    out = changed.unionByName(plain(fresh.join(old, "fact_id", "left_anti"), "created", "fact_id"))
    out = out.unionByName(plain(facts.where(within(F.col("retracted_at"))), "retracted", "fact_id"))
    out = out.unionByName(plain(entities.where(within(F.col("created_at"))), "new_entity", "entity_id"))
    return out if forgotten is None else out.unionByName(plain(forgotten.where(within(F.col("forgotten_at"))), "forgotten", "hash"))


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC by its definition: two nested hashes."""
    raw = key.encode().ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in raw).hex())) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def forget_entities(tables: dict[str, tuple[DataFrame, list[str]]], keys: DataFrame, secret: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table (with the columns that name an entity) without rows of the keys (entity_id), and tombstones: hash, facts.

    Tombstones hold no plain id.
    """
    kept = {}
    for name, (df, columns) in tables.items():
        out = df
        for c in columns:
            out = out.join(keys.select(F.col("entity_id").alias(c)), c, "left_anti").select(*df.columns)
        kept[name] = out
    facts = tables["facts"][0].join(keys, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("facts"))
    stones = keys.join(facts, "entity_id", "left").select(hmac_sha256(secret, F.col("entity_id")).alias("hash"), F.coalesce("facts", F.lit(0)).alias("facts"))
    return kept, stones


def forget_episodes(episodes: DataFrame, segments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """episodes without the gone ones (episode_id), and segments (segment_id, episode_ids) that hold none of them."""
    hit = segments.select("segment_id", F.explode("episode_ids").alias("episode_id")).join(gone, "episode_id", "left_semi").select("segment_id").distinct()
    return episodes.join(gone, "episode_id", "left_anti"), segments.join(hit, "segment_id", "left_anti")


def forget_users(tables: dict[str, tuple[DataFrame, dict[str, str]]], users: DataFrame, secret: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without what belongs to users (user_id), and tombstones: hash, facts, entities.

    A table comes with its columns by what they name: `user` (an owner), `fact` or `entity` (rows of the tables `facts` and
    `entities`). Rows go that a user owns, that name one of the users' facts or entities, and of `artifacts` also those of
    any entity that a user had a fact on, since its text may be in them.
    """
    gone = users.select("user_id").where("user_id IS NOT NULL").distinct()
    owned = lambda name, key: tables[name][0].join(gone, "user_id", "left_semi").select(key).distinct() if name in tables else None
    hit = {"user": gone, "fact": owned("facts", "fact_id"), "entity": owned("entities", "entity_id")}
    key = {"user": "user_id", "fact": "fact_id", "entity": "entity_id"}
    touched = tables["facts"][0].join(gone, "user_id", "left_semi").select("entity_id").distinct() if "facts" in tables else None
    kept = {}
    for name, (df, columns) in tables.items():
        out = df
        for kind, column in columns.items():
            rows = touched if name == "artifacts" and kind == "entity" else hit[kind]
            if rows is not None:
                out = out.join(rows.select(F.col(key[kind]).alias(column)), column, "left_anti").select(*df.columns)
        kept[name] = out
    stones = gone
    for name, count in (("facts", "facts"), ("entities", "entities")):
        if name in tables and "user_id" in tables[name][0].columns:
            stones = stones.join(tables[name][0].groupBy("user_id").agg(F.count("*").alias(count)), "user_id", "left")
        else:
            stones = stones.withColumn(count, F.lit(0))
    return kept, stones.select(hmac_sha256(secret, F.col("user_id")).alias("hash"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("facts", "entities")))


def world_union(facts: DataFrame, versions: list[str]) -> DataFrame:
    return facts.where(F.col("derived_version").isin(*versions))


def sweep_candidates(candidates: DataFrame, now: Column) -> DataFrame:
    """Pending ones older than 7 days expire, decided ones older than 30 days go."""
    age = lambda n: F.col("created_at") < now - F.make_dt_interval(F.lit(n))
    kept = candidates.where(~((F.col("status") != "pending") & age(30)))
    return kept.withColumn("status", F.when((F.col("status") == "pending") & age(7), "expired").otherwise(F.col("status")))


def sweep_documents(docs: DataFrame, facts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """docs within retain_until, and facts with source_purged where their document (hash) went."""
    gone = docs.where(F.col("retain_until") < now).select(F.concat(F.lit("doc:"), "hash").alias("origin_key"), F.lit(True).alias("__gone"))
    kept = docs.where(F.col("retain_until").isNull() | (F.col("retain_until") >= now))
    return kept, facts.join(gone, "origin_key", "left").withColumn("source_purged", F.coalesce("__gone", F.lit(False))).drop("__gone")


def gc_worlds(facts: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts of kept versions (version; a staging world `x#y` lives with x) and of the live world, and counts of removed versions.

    An empty keep set is refused.
    """
    if keep.isEmpty():
        raise ValueError("refusing to collect worlds with an empty keep set")
    base = F.substring_index("derived_version", "#", 1)
    named = facts.withColumn("__base", base)
    held = keep.select(F.col("version").alias("__base")).distinct()
    kept = named.join(held, "__base", "left_semi").select(*facts.columns).unionByName(facts.where("derived_version IS NULL"))
    removed = named.where("derived_version IS NOT NULL").join(held, "__base", "left_anti").groupBy("derived_version").agg(F.count("*").alias("n"))
    return kept, removed


def upsert_usage(old: DataFrame, reads: DataFrame) -> DataFrame:
    """fact_id, read_count, last_read_at of the old table with reads (fact_id, at) added."""
    new = reads.groupBy("fact_id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    return old.join(new, "fact_id", "full").select("fact_id", (F.coalesce("read_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("read_count"), F.greatest("last_read_at", "at").alias("last_read_at"))
