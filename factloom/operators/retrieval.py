"""The retrieval pipeline for tables of queries: fuse, score, bucket, assemble."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators.joins import union_refs
from factloom.operators.trust import calibrate

#: Weights by salience 0 to 3; half-life and floor of distance in time; weight of supplementary facts.
SALIENCE = (0.8, 1.0, 1.1, 1.25)
HALF_LIFE_DAYS, FLOOR, DEGREE_WEIGHT, SUPPLEMENTS, CORROBORATION_CAP = 90.0, 0.25, 0.3, 2, 3


#: Fixed value: predicates of small talk.
CHATTER = ("said",)


def clamp01(x: Column) -> Column:
    return F.when(x <= 0, 0.0).when(x > 1, 1.0).otherwise(x)


def squash(x: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x / (1 + x))


def fuse(vector: DataFrame, lexical: DataFrame, weight: float = 0.5) -> DataFrame:
    """query_id, fact_id, fused, stages from (query_id, fact_id, similarity) and (query_id, fact_id, bm25)."""
    keys = ["query_id", "fact_id"]
    both = vector.select(*keys, "similarity").join(lexical.select(*keys, "bm25"), keys, "full")
    fused = weight * F.coalesce(clamp01(F.col("similarity")), F.lit(0.0)) + (1 - weight) * F.coalesce(squash(F.col("bm25")), F.lit(0.0))
    stages = F.concat_ws(",", F.when(F.col("similarity").isNotNull(), "vector"), F.when(F.col("bm25").isNotNull(), "lexical"))
    return both.select(*keys, fused.alias("fused"), stages.alias("stages"))


def rrf_fuse(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, fact_id, rrf: the sum of 1 / (k + rank) over ranked lists (query_id, fact_id, rank)."""
    every = lists[0].select("query_id", "fact_id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", "fact_id", "rank"))
    return every.groupBy("query_id", "fact_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def fade(gap_days: Column) -> Column:
    return FLOOR + (1 - FLOOR) * F.exp(-F.lit(0.6931471805599453) * F.greatest(F.lit(0.0), gap_days) / HALF_LIFE_DAYS)


def read_decay(now: Column, recorded: Column, last_read: Column, half_life: Column) -> Column:
    """The clock restarts at the last read; no half-life, no decay."""
    age = days_between(now, F.greatest(recorded, F.coalesce(last_read, recorded)))
    return F.when(half_life.isNull(), 1.0).otherwise(F.exp(-F.lit(0.6931471805599453) * age / half_life))


def overlap_factor(moment: Column) -> Column:
    """1 if valid at the moment, else fading with the distance."""
    start, end = F.col("valid_from"), F.col("valid_until")
    inside = (start <= moment) & (end.isNull() | (end > moment))
    return F.when(start.isNull() | inside, 1.0).otherwise(fade(F.when(start > moment, days_between(start, moment)).otherwise(days_between(moment, end))))


def period_factor(begin: Column, stop: Column, mention: Column | None = None) -> Column:
    """1 in a query's period, else fading. An interval overlaps, an open fact is anchored on its start, a mention rescues."""
    start, end = F.col("valid_from"), F.col("valid_until")
    inside = F.when(end.isNotNull(), (start < stop) & (begin < end)).otherwise((start >= begin) & (start < stop))
    told = F.lit(False) if mention is None else F.coalesce((mention >= begin) & (mention < stop), F.lit(False))
    gap = F.when(start >= stop, days_between(start, stop)).otherwise(days_between(begin, F.coalesce(end, start)))
    return F.when(start.isNull() | inside | told, 1.0).otherwise(fade(gap))


def trust_factor(reputation: Column, corroborations: Column, authority: Column, beta: float, gamma: float, delta: float) -> Column:
    return (1 + beta * (reputation - 0.5)) * (1 + gamma * F.least(corroborations, F.lit(CORROBORATION_CAP))) * (1 + delta * authority)


def salience_factor(salience: Column) -> Column:
    return F.coalesce(F.when(salience.between(0, 3), F.element_at(F.array(*map(F.lit, SALIENCE)), (salience + 1).cast("int"))), F.lit(1.0))


def diversity_key(predicate: Column, text: Column) -> Column:
    """The predicate and the first three words of three letters or more, sorted."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda t: F.char_length(t) >= 3)
    return F.concat_ws("|", predicate, F.array_join(F.array_sort(F.slice(words, 1, 3)), " "))


def score_facts(
    fused: DataFrame, registry: DataFrame, now: Column, moment: Column | None = None, period: tuple[Column, Column] | None = None,
    steps: DataFrame | None = None, chatter: float = 1.0, beta: float = 0.0, gamma: float = 0.0, delta: float = 0.0, salience: bool = False,
) -> DataFrame:
    """fused rows joined with their facts get score, the product of fused and ten factors, each 1 where it is not asked for.

    Decay since recorded_at or last_read_at by the predicate's half-life; confidence, rewritten by calibration steps (one row:
    thresholds, values); a penalty for CHATTER predicates, if within 0 and 1; trust (learned_trust unless it is a neutral half, else
    declared_trust), corroborations (corroboration_count) and authority with the weights beta, gamma, delta; distance from a moment
    and from a query's period; salience (a whole number from 0 to 3). A canonical predicate_alias stands for its predicate.
    Columns that facts lack count as null.
    """
    held = lambda c: F.col(c) if c in fused.columns else F.lit(None)
    rows = fused.withColumn("__canon", F.coalesce(held("predicate_alias").cast("string"), F.col("predicate")))
    rows = rows.join(registry.select(F.col("predicate").alias("__canon"), F.col("half_life_days").alias("__half")), "__canon", "left")
    confidence = F.col("confidence")
    if steps is not None:
        rows = rows.crossJoin(F.broadcast(steps.limit(1).select(F.col("thresholds").alias("__at"), F.col("values").alias("__to"))))
        confidence = calibrate(confidence, F.col("__at"), F.col("__to"))
    learned, declared = held("learned_trust").cast("double"), held("declared_trust").cast("double")
    reputation = F.coalesce(F.when(learned != 0.5, learned), declared, F.lit(0.5))
    score = F.col("fused") * read_decay(now, F.col("recorded_at"), held("last_read_at"), F.col("__half")) * confidence
    if 0 < chatter < 1:
        score = score * F.when(F.col("__canon").isin(*CHATTER), chatter).otherwise(1.0)
    score = score * trust_factor(reputation, F.coalesce(held("corroboration_count").cast("double"), F.lit(0.0)), F.coalesce(held("authority").cast("double"), F.lit(0.0)), beta, gamma, delta)
    if moment is not None:
        score = score * overlap_factor(moment)
    if period is not None:
        score = score * period_factor(*period, held("mentioned_at").cast("timestamp"))
    if salience:
        score = score * salience_factor(held("salience").cast("double"))
    return rows.withColumn("score", score).drop("__canon", "__half", "__at", "__to")


def bucket_entities(scored: DataFrame) -> DataFrame:
    """query_id, entity_id, best, rank_score: the best score plus 0.3 x the next two with other diversity keys."""
    key = diversity_key(F.col("predicate"), F.col("object"))
    per_key = scored.withColumn("key", key).groupBy("query_id", "entity_id", "key").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id", "entity_id").orderBy(F.desc("score"), "key"))
    ranked = per_key.withColumn("rank", rank).where(F.col("rank") <= 1 + SUPPLEMENTS)
    more = F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("score"))), F.lit(0.0))
    return ranked.groupBy("query_id", "entity_id").agg(F.max("score").alias("best"), (F.max("score") + DEGREE_WEIGHT * more).alias("rank_score"))


def fact_centric(hits: DataFrame, budget: int, limit: int, priority: DataFrame | None = None) -> DataFrame:
    """The best `budget` facts of each query, under at most `limit` entities.

    hits: query_id, entity_id, fact_id, score; adds fact_rank and entity_rank. Entities stand in the order that priority
    (query_id, entity_id, place) gives, if it has them, and behind these by their best fact.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "fact_id"))
    kept = hits.withColumn("fact_rank", rank).where(F.col("fact_rank") <= budget)
    if priority is not None:
        places = priority.groupBy("query_id", "entity_id").agg(F.min("place").alias("__place"))
        kept = kept.join(places, ["query_id", "entity_id"], "left")
    else:
        kept = kept.withColumn("__place", F.lit(None).cast("int"))
    first = F.min("fact_rank").over(W.partitionBy("query_id", "entity_id"))
    entity = F.dense_rank().over(W.partitionBy("query_id").orderBy(F.col("__place").asc_nulls_last(), "__first"))
    ranked = kept.withColumn("__first", first).withColumn("entity_rank", entity).where(F.col("entity_rank") <= limit)
    return ranked.drop("__first", "__place").select(*hits.columns, "fact_rank", "entity_rank")


def keyset_page(df: DataFrame, after: tuple, n: int) -> DataFrame:
    """The n rows behind (occurred_at, id) in that order."""
    at, key = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
    later = (F.col("occurred_at") > at) | ((F.col("occurred_at") == at) & (F.col("id") > key))
    return df.where(later).orderBy("occurred_at", "id").limit(n)


def capped_sections(df: DataFrame, cap: int) -> DataFrame:
    """At most cap rows of each section by id, with truncated."""
    part = W.partitionBy("section")
    rows = df.withColumn("__r", F.row_number().over(part.orderBy("id"))).where(F.col("__r") <= cap + 1)
    return rows.withColumn("truncated", F.max("__r").over(part) > cap).where(F.col("__r") <= cap).drop("__r")


def profile_sections(facts: DataFrame, per_aspect: int, most: int, persona: str = "persona") -> DataFrame:
    """A user's facts (user_id, aspect, fact_id, valid_from): persona first, then larger sections, then by name, cut in all."""
    section = W.partitionBy("user_id", "aspect")
    rows = facts.withColumn("n", F.count("*").over(section)).withColumn("r", F.row_number().over(section.orderBy(F.desc("valid_from"), "fact_id"))).where(F.col("r") <= per_aspect)
    order = W.partitionBy("user_id").orderBy(F.when(F.col("aspect") == persona, 0).otherwise(1), F.desc("n"), "aspect", "r")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("user_id", "aspect", "fact_id", "place")


def arc_beats(facts: DataFrame, n: int = 12) -> DataFrame:
    """The n facts with the highest topicality per topic, with seq in time order."""
    best = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("topicality"), "fact_id"))
    seq = F.row_number().over(W.partitionBy("topic").orderBy("valid_from", "fact_id"))
    return facts.withColumn("__b", best).where(F.col("__b") <= n).withColumn("seq", seq).drop("__b")


def recent_digests(digests: DataFrame, user: str, n: int = 4) -> DataFrame:
    """The newest n digests (digest_id, users, at) that are global or for exactly this user."""
    mine = (F.size("users") == 0) | ((F.size("users") == 1) & (F.get("users", 0) == user))
    return digests.where(mine).orderBy(F.desc("at"), "digest_id").limit(n)


def combine_hops(prev: DataFrame, cur: DataFrame, how: str) -> DataFrame:
    """Hits (query_id, entity_id, score) of two hops: seed, union, intersect or subset_of_previous; the newer hit wins."""
    keys = ["query_id", "entity_id"]
    if how == "seed":
        return cur
    if how == "union":
        return cur.unionByName(prev.join(cur, keys, "left_anti"))
    return cur.join(prev, keys, "left_semi")


def merge_evidence(base: DataFrame, extra: DataFrame, cap: int) -> DataFrame:
    """base, then per query at most cap best facts of extra that base lacks. Both: query_id, entity_id, fact_id, score."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "fact_id"))
    more = extra.join(base, ["query_id", "fact_id"], "left_anti").withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r")
    return base.withColumn("source", F.lit(0)).unionByName(more.withColumn("source", F.lit(1)))


def rescore_window(facts: DataFrame, external: DataFrame, window: int) -> DataFrame:
    """In each query's first `window` facts, the k-th score goes to the fact that an external ranking puts k-th."""
    rank = lambda s: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(s), "fact_id"))
    ranked = facts.withColumn("place", rank("score"))
    top = ranked.where(F.col("place") <= window)
    moved = top.join(external, ["query_id", "fact_id"], "left").withColumn("place", rank("external")).drop("score", "external")
    scores = top.select("query_id", "place", "score")
    return moved.join(scores, ["query_id", "place"]).select(*facts.columns).unionByName(ranked.where(F.col("place") > window).select(*facts.columns))


def expansion_terms(hits: DataFrame, queries: DataFrame, names: DataFrame, n: int = 3) -> DataFrame:
    """query_id, text of every query, with the names of up to n best entities that it doesn't mention; a query without such stays as it is."""
    named = hits.join(names, "entity_id").join(queries.select("query_id", "text"), "query_id").where(~F.contains(F.lower("text"), F.lower("canonical_name")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rank_score"), "entity_id"))
    top = named.withColumn("r", rank).where(F.col("r") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "canonical_name"))).alias("c"))
    told = queries.select("query_id", "text").join(top, "query_id", "left")
    return told.select("query_id", F.concat_ws(" ", "text", F.transform(F.coalesce("c", F.array()), lambda x: x["canonical_name"])).alias("text"))


def assemble_hits(scored: DataFrame, buckets: DataFrame, limit: int, per_entity: int = 5) -> DataFrame:
    """query_id, entity_rank, entity_id, rank_score, facts: the best entities, each with its best facts in order.

    If facts have refs (a map), refs are those of the facts shown; of a key the best fact's stays.
    """
    told = ["refs"] if "refs" in scored.columns else []
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rank_score"), "entity_id"))
    top = buckets.withColumn("entity_rank", rank).where(F.col("entity_rank") <= limit)
    nth = F.row_number().over(W.partitionBy("query_id", "entity_id").orderBy(F.desc("score"), "fact_id"))
    best = scored.withColumn("nth", nth).where(F.col("nth") <= per_entity)
    facts = best.groupBy("query_id", "entity_id").agg(F.array_agg(F.struct("nth", "fact_id", *told)).alias("f"))
    ordered = F.array_sort("f", lambda a, b: a["nth"] - b["nth"])
    none = F.create_map().cast("map<string,string>")
    merged = [F.aggregate(ordered, none, lambda acc, x: union_refs(x["refs"], acc)).alias("refs")] if told else []
    shown = F.transform(ordered, lambda x: x["fact_id"]).alias("facts")
    return top.join(facts, ["query_id", "entity_id"]).select("query_id", "entity_rank", "entity_id", "rank_score", shown, *merged)
