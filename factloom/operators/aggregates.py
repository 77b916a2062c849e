"""Aggregates over facts, decisions, usage and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ONE = "*"


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def stats_overview(facts: DataFrame, now: Column) -> DataFrame:
    """One row: facts, active, superseded, retracted, competing, entities with facts, recorded in the last 7 days."""
    by = lambda s: F.count_if(F.col("status") == s).alias(s)
    return facts.agg(
        F.count(ONE).alias("facts"), by("active"), by("superseded"), by("retracted"), by("competing"),
        F.count_distinct("entity_id").alias("entities"),
        F.count_if((F.col("recorded_at") > now - _days(7)) & (F.col("recorded_at") <= now)).alias("last_week"),
    )


def memory_quality(facts: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """One row: active facts beyond 30, 90, 365 days; trust bands (low < 0.4, high > 0.6); orphan entities."""
    age = lambda n: F.count_if((F.col("status") == "active") & (F.col("recorded_at") < now - _days(n))).alias(f"older_{n}")
    trust, active = F.coalesce("trust", F.lit(0.5)), F.col("status") == "active"
    facts_row = facts.agg(
        age(30), age(90), age(365),
        F.count_if(active & (trust < 0.4)).alias("low"), F.count_if(active & (trust > 0.6)).alias("high"),
        F.count_if(active & (trust >= 0.4) & (trust <= 0.6)).alias("neutral"),
    )
    lonely = entities.where("merged_into IS NULL").join(facts.where(active), "entity_id", "left_anti").agg(F.count(ONE).alias("orphans"))
    return facts_row.join(lonely)


def pii_inventory(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """predicate, pii_class, active, retracted of classified predicates."""
    classified = registry.where("pii_class IS NOT NULL").select("predicate", "pii_class")
    return facts.join(classified, "predicate").groupBy("predicate", "pii_class").agg(
        F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "retracted").alias("retracted")
    )


def decision_series(decisions: DataFrame) -> DataFrame:
    """Per day: allow, deny, would_deny."""
    by = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return decisions.groupBy(F.to_date("at").cast("string").alias("day")).agg(by("allow"), by("deny"), by("would_deny"))


def decision_top(decisions: DataFrame, n: int = 10) -> DataFrame:
    """kind (action or rule), value, denials: the n most denied of each kind from one pass."""
    denied = decisions.where("decision = 'deny'").groupingSets([["action"], ["rule_id"]], "action", "rule_id").agg(
        F.count(ONE).alias("denials"), F.grouping_id().alias("g")
    )
    kinds = denied.select(F.when(F.col("g") == 1, "action").otherwise("rule").alias("kind"), F.coalesce("action", "rule_id").alias("value"), "denials")
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("denials"), "value"))
    return kinds.withColumn("rank", rank).where(F.col("rank") <= n)


def ended_before(facts: DataFrame, cutoff: Column) -> DataFrame:
    return facts.where(((F.col("valid_until") < cutoff) | (F.col("retracted_at") < cutoff)) & (F.col("status") != "compacted"))


GROUP = ["entity_id", "predicate", "user_id"]
#: Episode ids that a rollup names at most.
EPISODES = 64
#: Fixed value: words that deny.
NEGATION = r"(?i)\b(?:never|has(?:n't| not)|have(?:n't| not)|did(?:n't| not)|does not|doesn't)\b"


def compaction_groups(facts: DataFrame, cutoff: Column, cap: int = 8000, least: int = 2, summary: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per (entity, predicate, user) with `least` ended facts or more: count, the first `cap` characters of their joined texts, mean confidence, bounds.

    Only lines that start within the cap are gathered. A summary gets them as an array and gives the text instead.
    """
    joined = summary or (lambda lines: F.array_join(lines, "; "))
    before = W.partitionBy(*GROUP).orderBy("valid_from", "fact_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("object") + 2).over(before), F.lit(0))
    line = F.when(F.col("__start") < cap, F.struct("valid_from", "fact_id", "object"))
    return (
        ended_before(facts, cutoff).withColumn("__start", start).groupBy(*GROUP)
        .agg(F.count(ONE).alias("n"), F.array_sort(F.collect_list(line)).alias("l"), F.avg("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"),
             F.max(F.coalesce(F.least("valid_until", "retracted_at"), "valid_until", "retracted_at")).alias("valid_until"))
        .where(F.col("n") >= least)
        .select(*GROUP, "n", F.substring(joined(F.transform("l", lambda x: x["object"])), 1, cap).alias("text"), "confidence", "valid_from", "valid_until")
    )


def compact(facts: DataFrame, cutoff: Column, least: int = 2) -> DataFrame:
    """facts with members of compaction groups set to compacted; groups meet their members again by key."""
    ended = ended_before(facts, cutoff)
    groups = ended.groupBy(*GROUP).agg(F.count(ONE).alias("__n")).where(F.col("__n") >= least).select(F.struct(*GROUP).alias("__g"))
    gone = ended.select("fact_id", F.struct(*GROUP).alias("__mine")).join(groups, F.col("__mine").eqNullSafe(F.col("__g")), "left_semi").select("fact_id", F.lit(True).alias("__gone"))
    return facts.join(gone, "fact_id", "left").withColumn("status", F.when(F.col("__gone"), "compacted").otherwise(F.col("status"))).drop("__gone")


def promotion_groups(facts: DataFrame, registry: DataFrame, cutoff: Column, least: int = 5, summary: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per (entity, predicate) of append-only predicates with `least` aged active facts or more: count, first, last, objects
    (the distinct ones, in order, or what a summary makes of them)."""
    joined = summary or (lambda lines: F.array_join(lines, ","))
    append = registry.where("semantics = 'append_only'").select("predicate")
    aged = facts.where((F.col("status") == "active") & (F.col("recorded_at") < cutoff)).join(append, "predicate", "left_semi")
    return aged.groupBy("entity_id", "predicate").agg(
        F.count(ONE).alias("n"), F.min("valid_from").alias("first_from"), F.max("valid_from").alias("last_from"),
        F.array_sort(F.collect_set("object")).alias("objects"),
    ).where(F.col("n") >= least).withColumn("objects", joined(F.col("objects")))


def aspect_rollups(facts: DataFrame, budget: int = 400, least: int = 3) -> DataFrame:
    """Per (entity, predicate): distinct texts, earliest first, as many as fit the budget, then "…and N more".

    With episode_ids (an array), episodes are the first EPISODES distinct ones of the texts shown.
    """
    told = F.col("episode_ids") if "episode_ids" in facts.columns else F.array().cast("array<string>")
    slot = W.partitionBy("entity_id", "predicate")
    first = F.row_number().over(W.partitionBy("entity_id", "predicate", "object").orderBy("valid_from", "fact_id"))
    used = F.sum(F.char_length("object") + 1).over(slot.orderBy("valid_from", "fact_id").rowsBetween(W.unboundedPreceding, 0))
    rows = facts.withColumn("__first", first).where("__first = 1").withColumn("__used", used).withColumn("__n", F.count(ONE).over(slot))
    grouped = rows.where(F.col("__n") >= least).groupBy("entity_id", "predicate").agg(
        F.max("__n").alias("n"), F.count_if(F.col("__used") <= budget).alias("shown"),
        F.array_sort(F.collect_list(F.when(F.col("__used") <= budget, F.struct("valid_from", "fact_id", "object", F.coalesce(told, F.array().cast("array<string>")).alias("told"))))).alias("l"),
    )
    episodes = F.slice(F.array_distinct(F.flatten(F.transform("l", lambda x: x["told"]))), 1, EPISODES)
    text = F.array_join(F.transform("l", lambda x: x["object"]), "\n")
    more = F.when(F.col("n") > F.col("shown"), F.concat(F.lit("\n…and "), F.col("n") - F.col("shown"), F.lit(" more"))).otherwise("")
    return grouped.select("entity_id", "predicate", "n", "shown", F.concat(text, more).alias("text"), episodes.alias("episodes"))


def densest_entities(facts: DataFrame, k: int) -> DataFrame:
    return facts.where("status = 'active'").groupBy("entity_id").agg(F.count(ONE).alias("n")).orderBy(F.desc("n"), "entity_id").limit(k)


def contested_slots(facts: DataFrame) -> DataFrame:
    """Slots with competing facts: how many, and how many distinct objects."""
    return facts.where("status = 'competing'").groupBy("entity_id", "predicate").agg(
        F.count(ONE).alias("n"), F.count_distinct("object").alias("objects")
    )


def evidence_conflicts(facts: DataFrame) -> DataFrame:
    """entity_id, predicate, n, objects, competing, negated of slots whose objects differ and of which a fact competes, or
    some but not all deny (hold a word of NEGATION)."""
    counts = facts.groupBy("entity_id", "predicate").agg(
        F.count(ONE).alias("n"), F.count_distinct("object").alias("objects"), F.count_if(F.lower("status") == "competing").alias("competing"),
        F.count_if(F.regexp_like("object", F.lit(NEGATION))).alias("negated"),
    )
    split = (F.col("negated") > 0) & (F.col("negated") < F.col("n"))
    return counts.where((F.col("objects") >= 2) & ((F.col("competing") > 0) | split))


def resolvable_pairs(facts: DataFrame, before: Column) -> DataFrame:
    """Competing facts of slots that have exactly two (counted before the age gate), both recorded before a moment."""
    n = F.count(ONE).over(W.partitionBy("entity_id", "predicate"))
    newest = F.max("recorded_at").over(W.partitionBy("entity_id", "predicate"))
    both = facts.where("status = 'competing'").withColumn("__n", n).withColumn("__newest", newest)
    return both.where((F.col("__n") == 2) & (F.col("__newest") < before)).select(*facts.columns)


def self_consistency(passes: DataFrame, n_passes: int) -> DataFrame:
    """Per (batch, cluster): share of passes that have it, and the batch's Shannon entropy in nats over clusters."""
    clusters = passes.groupBy("batch", "cluster").agg(F.count_distinct("pass").alias("n"))
    total = F.sum("n").over(W.partitionBy("batch"))
    p = F.col("n") / F.col("total")
    entropy = F.sum(-p * F.ln(p)).over(W.partitionBy("batch"))
    return clusters.withColumn("total", total).select("batch", "cluster", (F.col("n") / n_passes).alias("share"), F.round(entropy, 9).alias("entropy"))


def conversation_counts(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conversation_id").agg(F.count(ONE).alias("n"))


def cost_breakdown(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """model, operation, tokens, cost per model, per operation and in all. usage: model, operation, tokens; pricing: model, price."""
    priced = usage.join(pricing, "model", "left").withColumn("cost", F.col("tokens") * F.coalesce("price", F.lit(0.0)))
    return priced.groupingSets([["model"], ["operation"], []], "model", "operation").agg(
        F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost")
    )


def ingest_outcomes(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count(ONE).alias("n"))


def indexer_attribution(facts: DataFrame) -> DataFrame:
    """Facts per namespace of a predicate `pack__name`; others are core."""
    pack = F.when(F.col("predicate").contains("__"), F.substring_index("predicate", "__", 1)).otherwise("core")
    return facts.groupBy(pack.alias("pack")).agg(F.count(ONE).alias("n"))


def conversation_scopes(turns: DataFrame) -> DataFrame:
    """Per conversation its users, sorted and comma-joined, and the user if there is just one."""
    users = F.array_sort(F.collect_set("user_id"))
    return turns.groupBy("conversation_id").agg(users.alias("u")).select(
        "conversation_id", F.array_join("u", ",").alias("users"), F.when(F.size("u") == 1, F.get("u", 0)).alias("only_user")
    )


def source_report(registry: DataFrame, trust: DataFrame) -> DataFrame:
    """Per source: declared, global rate, number of scoped domains and the one with most samples. registry: source_key, declared."""
    seen = trust.groupBy("source_key").agg(
        F.max(F.when(F.col("domain").isNull(), F.col("rate"))).alias("rate"),
        F.count("domain").alias("domains"),
        F.max_by(F.col("domain"), F.when(F.col("domain").isNotNull(), F.struct("samples", "domain"))).alias("main_domain"),
    )
    return registry.join(seen, "source_key", "full")


def source_history(history: DataFrame, last: int = 100) -> DataFrame:
    """The last rows of each source's history (source_key, domain, rate, recorded_at), n counting back from 1."""
    back = F.row_number().over(W.partitionBy("source_key").orderBy(F.desc("recorded_at"), "domain"))
    return history.withColumn("n", back).where(F.col("n") <= last)


def rewrite_pattern_counts(pairs: DataFrame) -> DataFrame:
    """Per folded pattern: its latest replacement and how often it was seen. pairs: pattern, replacement, at."""
    return pairs.groupBy(F.lower(F.trim("pattern")).alias("pattern")).agg(
        F.max_by("replacement", F.struct("at", "replacement")).alias("replacement"), F.count(ONE).alias("seen")
    )


def change_lag(changes: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per source the changes (source, version) beyond its cursor (source, cursor)."""
    behind = changes.join(cursors, "source", "left").where(F.col("version") > F.coalesce("cursor", F.lit(-1)))
    return behind.groupBy("source").agg(F.count(ONE).alias("lag"))


def forget_report(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """kind, key, removed: rows of each table (with entity_id) that belong to the keys."""
    out = None
    for kind, df in tables.items():
        part = df.join(keys, "entity_id", "left_semi").groupBy("entity_id").agg(F.count(ONE).alias("removed")).select(F.lit(kind).alias("kind"), "entity_id", "removed")
        out = part if out is None else out.unionByName(part)
    return out
