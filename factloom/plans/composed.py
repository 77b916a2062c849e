"""Queries over whole retrieval plans and column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import joins as J
from factloom.operators import resolution as Z
from factloom.operators import retrieval as R
from factloom.operators import search as P
from factloom.operators import trust as T
from factloom.operators.graph import written
from factloom.plans.catalog import NOW, World, query

COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _numbered(w: World) -> DataFrame:
    """Facts of the view with the number of one of the vectors each, and words to find them by."""
    n = w.embeddings.count()
    held = written(w.embeddings.select("vec_id"))  # its size is that of the numbers
    rows = w.facts.withColumn("vec_id", F.col("n") % n).join(held, "vec_id", "left_semi")
    return rows.withColumn("haystack", F.concat_ws(" ", "predicate", "recorder", "object"))


def _embedded(w: World) -> DataFrame:
    """These with the vectors themselves."""
    return _numbered(w).join(w.embeddings.select("vec_id", "embedding"), "vec_id")


def _topics(w: World) -> DataFrame:
    words = "element_at(array('urgent phone', 'order status high', 'medium profile', 'low'), CAST(vec_id % 4 + 1 AS INT))"
    return w.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.expr(words).alias("text"), F.col("embedding").alias("q"))


@query("k10_search")
def k10(w: World) -> DataFrame:
    hits = P.search(_topics(w), _embedded(w), w.entities, w.edges, w.registry, F.expr(NOW), scopes=("pii:read",), alpha=0.2)
    return hits.select("query_id", "entity_rank", "entity_id", F.round("rank_score", 6).alias("rank_score"), F.array_join("facts", ",").alias("facts"))


@query("k7_expansion_terms")
def k7(w: World) -> DataFrame:
    hits = P.search(_topics(w), _embedded(w), w.entities, w.edges, w.registry, F.expr(NOW), scopes=("pii:read",))
    return R.expansion_terms(hits, _topics(w).select("query_id", "text"), w.entities.select("entity_id", "canonical_name"))


@query("k10_search_facts")
def k10b(w: World) -> DataFrame:
    """Facts first, in German where there are enough, asked twice, without what a policy denies for a fact or its document."""
    sets = ({"name": "no-low", "mode": "enforce", "default": "allow", "rules": [{"id": "low", "effect": "deny", "when": [("recorder", "eq", "5-LOW")]}]},)
    origins = w.facts.select("origin_key").distinct().withColumn("recorder", F.when(F.xxhash64("origin_key") % 10 == 3, "5-LOW"))
    more = {"sets": sets, "lang": "de", "expand": True, "docs": origins, "vectors": w.embeddings.select("vec_id", "embedding")}
    hits = P.search_facts(_topics(w), _numbered(w), w.entities, w.registry, F.expr(NOW), scopes=("pii:read",), **more)
    return hits.select("query_id", "fact_rank", "fact_id", "entity_rank", "entity_id", F.round("score", 6).alias("score"))


def _lines(facts: DataFrame, *vector: str) -> DataFrame:
    return facts.select("fact_id", F.col("entity_id").alias("session_key"), F.col("valid_from").alias("occurred_at"), F.col("haystack").alias("text"), *vector, "user_id", F.array().cast("array<string>").alias("pii_class"))


def _segments(w: World) -> DataFrame:
    return _lines(_embedded(w), "embedding")


@query("k11_mention_scan")
def k11(w: World) -> DataFrame:
    return P.mention_scan(_topics(w), _lines(_numbered(w), "vec_id"), vectors=w.embeddings.select("vec_id", "embedding"))


@query("k12_query_arcs", f"""
WITH f AS (SELECT f.fact_id, f.valid_from, e.vec_id, e.embedding FROM facts f JOIN embeddings e ON e.vec_id = f.n % (SELECT count(*) FROM embeddings) WHERE predicate <> 'summary_profile'),
b AS (SELECT a.vec_id AS topic, b.fact_id, b.valid_from FROM embeddings a, f b WHERE a.vec_id % 50 = 0 AND {COS} >= 0.35 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.fact_id) <= 12)
SELECT topic, fact_id, row_number() OVER (PARTITION BY topic ORDER BY valid_from, fact_id)::INTEGER AS seq FROM b""", "facts")
def k12(w: World) -> DataFrame:
    return P.query_arcs(_topics(w), _embedded(w))


@query("k15_match_entities", f"""
WITH e AS (SELECT c_custkey AS id, c_mktsegment AS type, regexp_replace(lower(trim(c_name)), '\\s+', ' ', 'g') AS name, 'alias ' || c_custkey AS alias, embedding FROM customer LEFT JOIN embeddings ON vec_id = c_custkey),
n AS (SELECT id AS name_id, type, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN alias ELSE 'other' END AS k, embedding FROM e),
said AS (SELECT name_id, min(e.id) AS entity_id, 'name' AS how FROM n JOIN e ON n.type = e.type AND n.k = e.name GROUP BY 1),
also AS (SELECT name_id, min(e.id) AS entity_id, 'alias' AS how FROM n JOIN e ON n.type = e.type AND n.k = e.alias WHERE name_id NOT IN (SELECT name_id FROM said) GROUP BY 1),
near AS (SELECT a.name_id, b.id AS entity_id, 'vector' AS how FROM n a JOIN e b ON a.type = b.type WHERE a.name_id NOT IN (SELECT name_id FROM said UNION SELECT name_id FROM also) AND {COS} >= 0.9
 QUALIFY row_number() OVER (PARTITION BY a.name_id ORDER BY round({COS}, 12) DESC, b.id) = 1)
FROM said UNION ALL FROM also UNION ALL FROM near""")
def k15(w: World) -> DataFrame:
    """Every customer; those beyond the number of vectors have none and are met by name alone."""
    entities = w.customer.join(w.embeddings.select(F.col("vec_id").alias("c_custkey"), "embedding"), "c_custkey", "left")
    entities = entities.selectExpr("c_custkey AS entity_id", "c_mktsegment AS type", "c_name AS canonical_name", "embedding", "array(concat('alias ', c_custkey)) AS aliases")
    called = "CASE entity_id % 3 WHEN 0 THEN concat('  ', upper(canonical_name)) WHEN 1 THEN concat('ALIAS  ', entity_id) ELSE 'other' END AS name"
    return P.match_entities(entities.selectExpr("entity_id AS name_id", "type", called, "embedding AS q"), entities)


@query("k16_segment_search")
def k16(w: World) -> DataFrame:
    return P.segment_search(_topics(w), _segments(w), "u3", 5)


@query("k17_insight_search")
def k17(w: World) -> DataFrame:
    return P.insight_search(_topics(w), _embedded(w))


@query("g9_multi_hop", """
WITH a AS (SELECT DISTINCT c_nationkey AS q, entity_id FROM facts JOIN customer ON entity_id = concat('c', c_custkey) WHERE predicate = 'phone'),
b AS (SELECT DISTINCT c_nationkey AS q, entity_id FROM facts JOIN customer ON entity_id = concat('c', c_custkey) WHERE predicate = 'order_status' AND object = 'P')
SELECT q AS query_id, entity_id FROM a INTERSECT SELECT q, entity_id FROM b""", "facts")
def g9(w: World) -> DataFrame:
    asked = w.facts.join(w.customer.selectExpr("concat('c', c_custkey) AS entity_id", "c_nationkey AS query_id"), "entity_id")
    hop = lambda cond: asked.where(cond).groupBy("query_id", "entity_id").agg(F.max("confidence").alias("score"))
    return P.multi_hop([(hop("predicate = 'phone'"), "seed"), (hop("predicate = 'order_status' AND object = 'P'"), "intersect")]).select("query_id", "entity_id")


@query("a22_ingest_outcomes", """
SELECT CASE WHEN origin_key IS DISTINCT FROM o THEN 'CORROBORATED' ELSE 'INSERTED' END AS outcome, count(*) AS n FROM (
 SELECT origin_key, first(origin_key) OVER (PARTITION BY entity_id, predicate, user_id, derived_version, object ORDER BY recorded_at, fact_id) AS o FROM facts WHERE retracted_at IS NULL) GROUP BY 1""", "facts")
def a22(w: World) -> DataFrame:
    return A.ingest_outcomes(Z.append_only(w.facts))


@query("h1_source_keys", "SELECT concat(vertical, ':', coalesce(recorder, '_')) AS source_key, count(*) AS n FROM facts GROUP BY 1", "facts")
def h1(w: World) -> DataFrame:
    return w.facts.groupBy(T.source_key(F.col("vertical"), F.col("recorder")).alias("source_key")).agg(F.count("*").alias("n"))


AGE = f"((epoch_us({NOW}) - epoch_us(recorded_at)) / 86400000000.0::DOUBLE)"


@query("h2_h4_conflict_score", f"""
SELECT fact_id, round(0.3::DOUBLE * confidence + 0.4::DOUBLE * CASE vertical WHEN 'billing' THEN 0.95 WHEN 'incidents' THEN 0.9 ELSE 0.5 END + 0.2::DOUBLE * exp(-{AGE} / 365) + 0.1::DOUBLE * (n % 2), 9) AS score FROM facts""", "facts")
def h4(w: World) -> DataFrame:
    age = R.days_between(F.expr(NOW), F.col("recorded_at"))
    score = T.conflict_score(F.col("confidence"), T.declared_trust(F.col("vertical")), T.recency(age), F.col("n") % 2)
    return w.facts.select("fact_id", F.round(score, 9).alias("score"))


@query("h5_read_decay", f"""
SELECT fact_id, round(CASE WHEN half_life_days IS NULL THEN 1 ELSE exp(-0.6931471805599453 * CASE WHEN n % 3 = 0 THEN {AGE} - 10 ELSE {AGE} END / half_life_days) END, 9) AS decay FROM facts JOIN registry USING (predicate)""", "facts registry")
def h5(w: World) -> DataFrame:
    rows = w.facts.join(w.registry, "predicate").withColumn("last_read_at", F.expr("CASE WHEN n % 3 = 0 THEN recorded_at + INTERVAL 10 DAYS END"))
    decay = R.read_decay(F.expr(NOW), F.col("recorded_at"), F.col("last_read_at"), F.col("half_life_days"))
    return rows.select("fact_id", F.round(decay, 9).alias("decay"))


@query("h7_h8_trust_factor", """
SELECT fact_id, round((1 + 0.5 * (CASE WHEN n % 5 = 0 OR n % 4 = 0 OR confidence = 0.5 THEN CASE vertical WHEN 'billing' THEN 0.95 WHEN 'incidents' THEN 0.9 ELSE 0.5 END ELSE confidence END - 0.5::DOUBLE)) * (1 + 0.1::DOUBLE * least(n % 6, 3)) * (1 + 0.2::DOUBLE * (n % 2)), 9) AS f FROM facts""", "facts")
def h8(w: World) -> DataFrame:
    learned = F.expr("CASE WHEN n % 5 = 0 THEN 0.5D WHEN n % 4 = 0 THEN NULL ELSE confidence END")
    reputation = T.trust_ladder(learned, T.declared_trust(F.col("vertical")))
    return w.facts.select("fact_id", F.round(R.trust_factor(reputation, F.col("n") % 6, F.col("n") % 2, 0.5, 0.1, 0.2), 9).alias("f"))


@query("h9_salience", "SELECT fact_id, CASE n % 6 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 1.1 WHEN 3 THEN 1.25 ELSE 1.0 END::DOUBLE AS f FROM facts", "facts")
def h9(w: World) -> DataFrame:
    return w.facts.select("fact_id", R.salience_factor(F.col("n") % 6).alias("f"))


@query("h15_folded_names", "SELECT DISTINCT regexp_replace(lower(trim(concat('  ', p_name, '  X '))), '\\s+', ' ', 'g') AS k FROM part")
def h15(w: World) -> DataFrame:
    return w.part.select(F.regexp_replace(F.lower(F.trim(F.concat(F.lit("  "), "p_name", F.lit("  X ")))), r"\s+", " ").alias("k")).distinct()


@query("ref_key", "SELECT p_partkey, replace(concat('v.x', '__', p_name), '.', '__') AS k FROM part")
def ref_key(w: World) -> DataFrame:
    return w.part.select("p_partkey", J.ref_key(F.lit("v.x"), F.col("p_name")).alias("k"))
