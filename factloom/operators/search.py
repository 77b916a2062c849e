"""Whole retrieval plans for tables of queries, composed of the smaller operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import lexical as X
from factloom.operators import retrieval as R
from factloom.operators import similarity as S
from factloom.operators.filters import lang_backoff, only_atomic, scope_gate, user_scope, world_fence
from factloom.operators.graph import expand_edges, pagerank_boost, personalized_pagerank, written
from factloom.operators.joins import reattribute_merged
from factloom.operators.neighbours import within
from factloom.operators.policy import apply_policy, policy_meta_union
from factloom.operators.sessions import best_mention_per_session
from factloom.operators.temporal import current_facts
from factloom.operators.text import LEAST_WORDS, dedupe_mentions, mention_words


def scored_facts(
    queries: DataFrame, facts: DataFrame, entities: DataFrame, registry: DataFrame, now: Column, user: str | None = None, scopes: tuple[str, ...] = (), sets: tuple[dict, ...] = (),
    limit: int = 10, lang: str | None = None, docs: DataFrame | None = None, expand: bool = False, vectors: DataFrame | None = None, **factors,
) -> DataFrame:
    """The facts that answer queries (query_id, text, q), with score: the pipeline of search() up to ranking.

    lang: facts in that language or none come first, others only where these are fewer than half of what is asked for. docs
    (origin_key and what policies look at): facts with a document that a policy denies drop out. expand: queries are asked
    again with the names of their best entities, and the better facts that this finds are merged in; the first results and the new
    queries are written to the shared folder in between. vectors (vec_id, embedding): those of facts, which have vec_id in place of
    embedding; one that many facts share is scored once. factors: as in score_facts.
    """
    k = min(5 * limit, 200)
    pool = written(world_fence(user_scope(current_facts(facts, now), user), [None]))  # read by every leg and for every field
    asks = queries.select("query_id", "q")
    near = S.exact_knn(asks, pool.where("embedding IS NOT NULL"), k) if vectors is None else S.shared_knn(asks, pool.select("fact_id", "vec_id"), vectors, k)
    if expand:
        near = written(near)  # the same for the new queries, whose vectors stay

    def ask(queries: DataFrame) -> DataFrame:
        said = X.bm25_fields(queries.select("query_id", "text"), pool, ["haystack", "object"], k)
        # Written, so that what was found is known to be little beside all facts.
        fused = reattribute_merged(written(R.fuse(near, said)).join(pool, "fact_id"), entities)
        if lang is not None:
            fused = lang_backoff(fused, lang, k)
        allowed = apply_policy(scope_gate(fused, registry, list(scopes)), list(sets)).where("decision <> 'deny'")
        if docs is not None:
            keyed = allowed.withColumn("origin_keys", F.array("origin_key"))
            allowed = policy_meta_union(keyed, docs, list(sets)).drop("origin_keys")
        return R.score_facts(allowed, registry, now, **factors)

    if not expand:
        return ask(queries)
    first = written(ask(queries))
    more = R.expansion_terms(R.bucket_entities(first), queries, entities.select("entity_id", "canonical_name"))
    again = ask(written(queries.drop("text").join(more, "query_id")))
    return R.merge_evidence(first, again, k).drop("source")


def search(
    queries: DataFrame, facts: DataFrame, entities: DataFrame, edges: DataFrame, registry: DataFrame, now: Column, user: str | None = None, scopes: tuple[str, ...] = (),
    sets: tuple[dict, ...] = (), limit: int = 10, alpha: float = 0.0, rank_graph: bool = False, **more,
) -> DataFrame:
    """query_id, entity_rank, entity_id, rank_score, facts. queries: query_id, text, q (vector); facts have embedding and haystack.

    Current facts in scope are searched by vector and by words, fused, re-keyed to survivors of merges, gated by language, scopes
    and policies, scored, gathered by entity, widened along edges (alpha > 0) and by PageRank (rank_graph), and assembled.
    more: as in scored_facts.
    """
    scored = scored_facts(queries, facts, entities, registry, now, user, scopes, sets, limit, **more)
    buckets = R.bucket_entities(scored).select("query_id", "entity_id", "rank_score")
    if alpha > 0:
        buckets = buckets.unionByName(expand_edges(buckets, edges, alpha).withColumnRenamed("score", "rank_score"))
    if rank_graph:
        seeds = buckets.select("query_id", F.col("entity_id").alias("node"), F.col("rank_score").alias("score"))
        buckets = pagerank_boost(buckets, personalized_pagerank(edges, seeds))
    return R.assemble_hits(scored, buckets, limit)


def search_facts(queries: DataFrame, facts: DataFrame, entities: DataFrame, registry: DataFrame, now: Column, budget: int = 20, limit: int = 10, **more) -> DataFrame:
    """query_id, fact_rank, fact_id, entity_rank, entity_id, score: search() by facts, the best `budget` under at most `limit` entities."""
    scored = scored_facts(queries, facts, entities, registry, now, limit=limit, **more)
    return R.fact_centric(scored, budget, limit).select("query_id", "fact_rank", "fact_id", "entity_rank", "entity_id", "score")


def running_sum(rows: DataFrame, by: str, order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same `by` up to their place, and rows at the same place.

    Rows go to tasks in ranges of their order, so that those of one `by` are summed by many.
    """
    spark = rows.sparkSession
    dealt = written(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, *order).withColumn("__part", F.spark_partition_id()))
    part = dealt.groupBy(by, "__part").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(W.partitionBy(by, "__part").orderBy(*order).rangeBetween(W.unboundedPreceding, W.currentRow))
    whole = dealt.withColumn("__in", inside).join(F.broadcast(part.select(by, "__part", before.alias("__before"))), [by, "__part"])
    return whole.withColumn(name, F.col("__before") + F.col("__in")).select(*rows.columns, name)


def mention_scan(topics: DataFrame, segments: DataFrame, floor: float = 0.35, share: float = 0.9, most: int = 60, vectors: DataFrame | None = None) -> DataFrame:
    """query_id, seq, text: for each topic (query_id, text, q) the lines of segments (fact_id, session_key, occurred_at, text, embedding)
    that match by word or are near enough to the topic's nearest; one a session, near-repeats dropped, oldest first.

    What matches by word is found, and its best line of each session taken, once for all topics with the same terms. A topic of its own
    differs from that in the sessions where it has near lines (floor is 0 or more), so only these are gone through topic by topic;
    of lines with equal words a topic's first one, which can stay, is looked up by its place among them. vectors (vec_id, embedding):
    those of segments, which have vec_id in place of embedding. A text or a vector that many lines share is scored once.
    """
    if floor < 0:
        raise ValueError("floor must be 0 or more")
    asks = written(topics.select("query_id", F.coalesce("text", F.lit("")).alias("text"), "q"))
    told = X.topic_terms(F.col("text"))
    form = F.when(F.size(told) > 0, F.concat(F.array(F.lit("any")), F.array_sort(told))).otherwise(F.concat(F.array(F.lit("all")), X.words(F.col("text"))))
    same, ones = X.one_of_each(asks, form)
    same = written(same)
    lines = written(segments.select("fact_id", "session_key", "occurred_at", "text", *([] if vectors is None else ["vec_id"])))
    words = mention_words(F.col("text"))
    texts = written(lines.groupBy("text").agg(F.count("*").alias("copies")).withColumn("fact_id", F.monotonically_increasing_id()))
    said = X.any_term_scores(ones, texts, ["text"]).select(F.col("query_id").alias("asked"), "fact_id", X.settled("bm25").alias("lexical"))
    said = written(said.join(texts, "fact_id").select("asked", "text", "lexical", words.alias("t")))
    if vectors is None:
        close = within(asks.select("query_id", "q"), segments, floor, share).join(lines, "fact_id")
    else:
        held = written(vectors.join(lines.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("fact_id"), "embedding"))
        close = written(within(asks.select("query_id", "q"), held, floor, share).withColumnRenamed("fact_id", "vec_id")).join(lines, "vec_id")
    close = close.select("query_id", "similarity", "fact_id", "session_key", "occurred_at", "text")

    # One line a session: of what is said, for topics with the same terms; again where a topic has near lines.
    base = best_mention_per_session(lines.join(said.withColumnRenamed("asked", "query_id"), "text").withColumn("similarity", F.lit(0.0)))
    base = written(base.select(F.col("query_id").alias("asked"), "session_key", "fact_id", "occurred_at", "text", "lexical", "t"))
    near = written(close.join(same, "query_id").join(said.drop("t"), ["asked", "text"], "left").na.fill(0.0, ["lexical"]))
    met = near.select("query_id", "asked", "session_key").distinct()
    again = met.join(base.select("asked", "session_key", "fact_id", "occurred_at", "text", "lexical"), ["asked", "session_key"]).withColumn("similarity", F.lit(0.0))
    own = best_mention_per_session(near.unionByName(again)).select("query_id", "asked", "fact_id", "occurred_at", "text")
    own = written(own)

    # Places: among all lines of the same terms, among those with equal words, and among those that never drop out.
    order, upto = ("occurred_at", "fact_id"), (W.unboundedPreceding, W.currentRow)
    of_base = base.select("asked", *order, "session_key", "text", "t", F.lit(1).alias("one"), F.lit(None).cast(own.schema["query_id"].dataType).alias("query_id"))
    of_own = own.select("asked", *order, F.lit(None).cast(base.schema["session_key"].dataType).alias("session_key"), "text", F.lit(None).cast(base.schema["t"].dataType).alias("t"), F.lit(0).alias("one"), "query_id")
    placed = written(running_sum(of_base.unionByName(of_own), "asked", order, "one", "p"))
    few = F.size("t") < LEAST_WORDS
    alike = F.when(few, F.array().cast("array<string>")).otherwise(F.col("t"))
    of_base = placed.where("one = 1").select("asked", *order, "session_key", "text", "p", few.alias("few"), alike.alias("t"))
    of_base = written(of_base.withColumn("r", F.row_number().over(W.partitionBy("asked", "t").orderBy(*order))))
    gone = written(met.join(of_base.drop("text"), ["asked", "session_key"]))

    # Of lines with equal words the first that the topic has: the first places that are gone without a gap come before it.
    nth = F.row_number().over(W.partitionBy("query_id", "t").orderBy("r"))
    lost = gone.where("NOT few").withColumn("nth", nth).where("r = nth").groupBy("query_id", "t").agg(F.count(F.lit(1)).alias("lost"))
    heads = of_base.where("r = 1 AND NOT few").select("asked", "t").join(same, "asked").join(lost, ["query_id", "t"], "left")
    first = heads.select("query_id", "asked", "t", (F.coalesce("lost", F.lit(0)) + 1).cast("int").alias("r"))
    # Of those that never drop out the first `most`, past those that are gone.
    less = gone.where("few").groupBy("query_id").agg(F.count(F.lit(1)).alias("less"))
    some = same.join(of_base.where("r = 1 AND few").select("asked"), "asked").join(less, "query_id", "left")
    some = some.select("query_id", "asked", F.array().cast("array<string>").alias("t"), F.explode(F.sequence(F.lit(1), (most + F.coalesce("less", F.lit(0))).cast("int"))).alias("r"))
    found = written(first.unionByName(some)).join(of_base.select("asked", "t", "r", *order, "text", "p"), ["asked", "t", "r"])
    found = found.join(gone.where("few").select("query_id", "fact_id"), ["query_id", "fact_id"], "left_anti").select("query_id", *order, "text", "p")
    # Of a topic's own lines with equal words only the first can stay, too.
    kept = placed.where("one = 0").select("query_id", *order, "text", "p").withColumn("t", words)
    nth = F.row_number().over(W.partitionBy("query_id", "t").orderBy(*order))
    kept = kept.where(few).unionByName(kept.where(~few).withColumn("r", nth).where(F.col("r") == 1).drop("r")).drop("t")
    mine = written(found.unionByName(kept))

    # A topic's place of a line: that among the same terms, less what is gone until there, and its own lines until there.
    change = mine.withColumn("change", F.lit(0)).unionByName(gone.select("query_id", *order, F.lit(-1).alias("change")), True).unionByName(own.select("query_id", *order, F.lit(1).alias("change")), True)
    moved = F.sum("change").over(W.partitionBy("query_id").orderBy(*order).rangeBetween(*upto))
    held = change.withColumn("seq", (F.col("p") + moved).cast("int")).where("p IS NOT NULL").select("query_id", "seq", "text")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("seq"))
    return dedupe_mentions(held, LEAST_WORDS).withColumn("n", nth).where(F.col("n") <= most).drop("n")


def query_arcs(topics: DataFrame, facts: DataFrame, floor: float = 0.35, beats: int = 12) -> DataFrame:
    """topic, fact_id, seq: the most topical atomic facts of each topic, in time order. facts: fact_id, predicate, recorder, valid_from, embedding."""
    atomic = only_atomic(facts)
    near = S.exact_knn(topics.select("query_id", "q"), atomic.select("fact_id", "embedding"), beats, floor)
    rows = near.join(atomic.select("fact_id", "valid_from"), "fact_id").select(F.col("query_id").alias("topic"), "fact_id", "valid_from", F.col("similarity").alias("topicality"))
    return R.arc_beats(rows, beats).select("topic", "fact_id", "seq")


def match_entities(names: DataFrame, entities: DataFrame, min_sim: float = 0.9) -> DataFrame:
    """name_id, entity_id, how: an entity of the same type with the same folded name, else one with such an alias (of several the
    least id), else the one with the nearest name vector.

    names: name_id, type, name, q; entities: entity_id, type, canonical_name, embedding, perhaps aliases (array). Names and
    entities without a vector are met by name only.
    """
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    called = entities.select("entity_id", "type", fold("canonical_name").alias("k"), F.lit(0).alias("place"))
    if "aliases" in entities.columns:
        called = called.unionByName(entities.select("entity_id", "type", F.explode("aliases").alias("k")).select("entity_id", "type", fold("k").alias("k"), F.lit(1).alias("place")))
    # Of equal names only the first can be an answer.
    called = called.groupBy("type", "k").agg(F.min(F.struct("place", "entity_id")).alias("m"))
    exact = names.select("name_id", "type", fold("name").alias("k")).join(called, ["type", "k"]).groupBy("name_id").agg(F.min("m").alias("m"))
    first = exact.select("name_id", F.col("m.entity_id").alias("entity_id"), F.when(F.col("m.place") == 0, "name").otherwise("alias").alias("how"))
    rest = names.where("q IS NOT NULL").join(first, "name_id", "left_anti")
    asked = rest.select(F.col("name_id").alias("query_id"), "type", "q")
    held = entities.where("embedding IS NOT NULL").select(F.col("entity_id").alias("fact_id"), "type", "embedding")
    best = S.exact_knn(asked, held, 1, min_sim, by="type").select(F.col("query_id").alias("name_id"), F.col("fact_id").alias("entity_id"), F.lit("vector").alias("how"))
    return first.unionByName(best)


def segment_search(queries: DataFrame, segments: DataFrame, user: str | None, k: int) -> DataFrame:
    """query_id, fact_id, rank of segments or turns (fact_id, text, embedding, user_id, pii_class) in scope without classified text."""
    open_ = written(user_scope(segments, user).where(F.coalesce(F.size("pii_class"), F.lit(0)) <= 0).select("fact_id", "text", "embedding"))
    fused = R.fuse(S.exact_knn(queries.select("query_id", "q"), open_, 4 * k), X.bm25(queries.select("query_id", "text"), open_, 4 * k, key="fact_id"))
    return X.top_k_per_query(fused, "fused", k).select("query_id", "fact_id", "rank")


def insight_search(queries: DataFrame, facts: DataFrame, budget: int = 4) -> DataFrame:
    """query_id, fact_id, rank over composed rows only, with a budget of their own."""
    composed = facts.join(only_atomic(facts).select("fact_id"), "fact_id", "left_anti")
    return segment_search(queries, composed.withColumn("pii_class", F.array().cast("array<string>")).withColumn("text", F.col("object")), None, budget)


def multi_hop(hops: list[tuple[DataFrame, str]], edges: DataFrame | None = None) -> DataFrame:
    """Hits of a planned chain: each hop (query_id, entity_id, score; how it combines) keeps to entities that the hop before
    reached, one edge further if edges are given."""
    reached = hops[0][0]
    for hits, how in hops[1:]:
        anchors = reached.select("query_id", "entity_id")
        if edges is not None:
            flat = edges.select("src", "dst").union(edges.select("dst", "src"))
            anchors = anchors.union(anchors.join(flat, F.col("entity_id") == F.col("src")).select("query_id", "dst")).distinct()
        near = hits.join(anchors, ["query_id", "entity_id"], "left_semi")
        reached = R.combine_hops(reached, near, how)
    return reached
