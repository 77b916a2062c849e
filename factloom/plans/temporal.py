"""Queries over temporal operators and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import filters as L
from factloom.operators import intervals as I
from factloom.operators import temporal as T
from factloom.plans.catalog import NOW, World, query

LIVE = "status NOT IN ('compacted', 'corroborating')"
PAST = "TIMESTAMP '1998-03-01 00:00:00'"


@query("f1_current_facts", f"""
SELECT fact_id, entity_id, object FROM facts WHERE retracted_at IS NULL AND status <> 'competing' AND valid_from <= {NOW}
 AND (valid_until IS NULL OR valid_until > {NOW}) AND {LIVE}""", "facts")
def f1(w: World) -> DataFrame:
    return T.current_facts(w.facts, NOW).select("fact_id", "entity_id", "object")


@query("f2_facts_as_of", f"""
SELECT fact_id, object FROM facts WHERE (retracted_at IS NULL OR retracted_at > {PAST}) AND valid_from <= {PAST}
 AND (valid_until IS NULL OR valid_until > {PAST}) AND {LIVE}""", "facts")
def f2(w: World) -> DataFrame:
    return T.facts_as_of(w.facts, PAST).select("fact_id", "object")


@query("f3_entity_facts_as_of", f"""
SELECT fact_id, object FROM facts WHERE recorded_at <= {PAST} AND (retracted_at IS NULL OR retracted_at > {PAST})
 AND valid_from <= {PAST} AND (valid_until IS NULL OR valid_until > {PAST}) AND {LIVE}""", "facts")
def f3(w: World) -> DataFrame:
    return T.entity_facts_as_of(w.facts, PAST).select("fact_id", "object")


@query("f4_facts_believed_at", f"""
SELECT f.fact_id, f.object FROM facts f LEFT JOIN facts s ON f.superseded_by = s.fact_id
WHERE f.recorded_at <= {PAST} AND (f.retracted_at IS NULL OR f.retracted_at > {PAST}) AND f.valid_from <= {PAST} AND f.{LIVE}
 AND ((f.superseded_by IS NOT NULL AND s.recorded_at > {PAST} AND (f.prior_valid_until IS NULL OR f.prior_valid_until > {PAST}))
  OR ((f.superseded_by IS NULL OR s.recorded_at <= {PAST}) AND (f.valid_until IS NULL OR f.valid_until > {PAST})))""", "facts")
def f4(w: World) -> DataFrame:
    return T.facts_believed_at(w.facts, PAST).select("fact_id", "object")


@query("f5_overlap_boost_pool", f"SELECT status, count(*) AS n FROM facts WHERE (retracted_at IS NULL OR retracted_at > {PAST}) AND {LIVE} GROUP BY status", "facts")
def f5(w: World) -> DataFrame:
    return T.overlap_boost_pool(w.facts, PAST).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("f6_audit_shapes", """
SELECT 'stale' AS shape, count(*) AS n FROM facts WHERE retracted_at IS NULL AND status <> 'competing'
UNION ALL SELECT 'all', count(*) FROM facts""", "facts")
def f6(w: World) -> DataFrame:
    stale = T.current_facts(w.facts, NOW, include_stale=True)
    every = T.current_facts(w.facts, NOW, include_stale=True, include_retracted=True, include_contested=True)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("shape"), "n")
    return count(stale, "stale").unionByName(count(every, "all"))


@query("f7_user_scope", "SELECT fact_id, user_id FROM facts WHERE user_id IS NULL OR user_id = 'u3'", "facts")
def f7(w: World) -> DataFrame:
    return L.user_scope(w.facts, "u3").select("fact_id", "user_id")


@query("f8_world_fence", "SELECT fact_id, derived_version FROM facts WHERE derived_version IS NULL OR derived_version = 'v1'", "facts")
def f8(w: World) -> DataFrame:
    return L.world_fence(w.facts, ["v1", None]).select("fact_id", "derived_version")


@query("f9_lang_backoff", """
WITH hits AS (SELECT entity_id AS query_id, fact_id, lang FROM facts),
own AS (SELECT *, 1 AS pass FROM hits WHERE lang = 'de' OR lang IS NULL),
enough AS (SELECT query_id FROM own GROUP BY 1 HAVING count(*) >= 4)
SELECT query_id, fact_id, min(pass) AS pass FROM (
 SELECT query_id, fact_id, pass FROM own UNION ALL SELECT query_id, fact_id, 2 FROM hits WHERE query_id NOT IN (SELECT query_id FROM enough)) u
GROUP BY ALL""", "facts")
def f9(w: World) -> DataFrame:
    hits = w.facts.select(F.col("entity_id").alias("query_id"), "fact_id", "lang")
    return L.lang_backoff(hits, "de", 8).select("query_id", "fact_id", "pass")


@query("f10_attribute_filters", """
SELECT fact_id FROM facts WHERE confidence >= 0.6 AND predicate IN ('phone', 'order_status') AND starts_with(predicate, 'ph') AND entity_id IN (SELECT entity_id FROM entities WHERE type IN ('building', 'machinery'))""", "facts entities")
def f10(w: World) -> DataFrame:
    return L.attribute_filters(w.facts, 0.6, ["phone", "order_status"], prefix="ph", types=["building", "machinery"], entities=w.entities).select("fact_id")


@query("f11_only_atomic", "SELECT predicate, count(*) AS n FROM facts WHERE NOT starts_with(predicate, 'summary_') AND recorder IS DISTINCT FROM 'aggregate-composer-v1' GROUP BY 1", "facts")
def f11(w: World) -> DataFrame:
    return L.only_atomic(w.facts).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("f12_require_provenance", "SELECT vertical, count(*) AS n FROM facts WHERE vertical IS NOT NULL OR recorder IS NOT NULL OR origin_key IS NOT NULL GROUP BY 1", "facts")
def f12(w: World) -> DataFrame:
    return L.require_provenance(w.facts).groupBy("vertical").agg(F.count(F.lit(1)).alias("n"))


@query("f13_edge_fence", f"""
SELECT src, dst FROM edges WHERE (user_id IS NULL OR user_id = 'u2') AND created_at <= {PAST} AND (invalidated_at IS NULL OR invalidated_at > {PAST})""", "edges")
def f13(w: World) -> DataFrame:
    return L.edge_fence(w.edges, "u2", F.expr(PAST)).select("src", "dst")


@query("f14_scope_gate", "SELECT predicate, count(*) AS n FROM facts WHERE predicate NOT IN (SELECT predicate FROM registry WHERE requires_scope IS NOT NULL) GROUP BY 1", "facts registry")
def f14(w: World) -> DataFrame:
    return L.scope_gate(w.facts, w.registry, []).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


@query("f17_quality_floor", "SELECT fact_id FROM facts WHERE confidence >= 0.5 AND CASE WHEN n % 2 = 0 THEN confidence ELSE 0.5 END >= 0.5", "facts")
def f17(w: World) -> DataFrame:
    hits = w.facts.withColumn("calibrated_confidence", F.lit(None).cast("double")).withColumn("reputation", F.expr("CASE WHEN n % 2 = 0 THEN confidence END"))
    return L.quality_floor(hits, 0.5, 0.5).select("fact_id")


@query("f18_coverage", """
SELECT entity_id AS query_id, max(confidence) AS top_score, count(*) AS n_facts, max(confidence) >= 0.9 AND count(*) >= 5 AS covered FROM facts GROUP BY 1""", "facts")
def f18(w: World) -> DataFrame:
    return L.coverage(w.facts.select(F.col("entity_id").alias("query_id"), F.col("confidence").alias("score")), 0.9, 5)


@query("j4_overlap_join", """
SELECT a.entity_id, count(*) AS n FROM facts a JOIN facts b ON a.entity_id = b.entity_id AND a.predicate = b.predicate AND a.fact_id < b.fact_id
 AND (b.valid_until IS NULL OR a.valid_from < b.valid_until) AND (a.valid_until IS NULL OR b.valid_from < a.valid_until) GROUP BY 1""", "facts")
def j4(w: World) -> DataFrame:
    pairs = I.overlap_join(w.facts, w.facts, ["entity_id", "predicate"]).where("fact_id < fact_id_b")
    return pairs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("j5_as_of_lookup", f"""
WITH probes AS (SELECT DISTINCT entity_id, predicate, TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(180 * k AS INTEGER)) AS moment FROM facts, range(8) AS r(k)),
held AS (SELECT p.*, f.fact_id, row_number() OVER (PARTITION BY p.entity_id, p.predicate, p.moment ORDER BY f.valid_from DESC, f.fact_id DESC) AS k
 FROM probes p LEFT JOIN facts f ON f.entity_id = p.entity_id AND f.predicate = p.predicate AND f.valid_from <= p.moment AND (f.valid_until IS NULL OR f.valid_until > p.moment)
 AND (f.retracted_at IS NULL OR f.retracted_at > p.moment) AND f.{LIVE})
SELECT entity_id, predicate, CAST(moment AS VARCHAR) AS at, fact_id FROM held WHERE k = 1""", "facts")
def j5(w: World) -> DataFrame:
    slots = w.facts.select("entity_id", "predicate").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    probes = slots.select("entity_id", "predicate", F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00' + make_dt_interval(180 * k)").alias("at"))
    return T.as_of_lookup(probes, w.facts, ["entity_id", "predicate"]).select("entity_id", "predicate", F.col("at").cast("string").alias("at"), "fact_id")


@query("w3_timeline", "SELECT fact_id, CAST(lead(valid_from) OVER (PARTITION BY entity_id, predicate ORDER BY valid_from, fact_id) AS VARCHAR) AS ends FROM facts", "facts")
def w3(w: World) -> DataFrame:
    return T.timeline(w.facts, ["entity_id", "predicate"]).select("fact_id", F.col("valid_until").cast("string").alias("ends"))


@query("w5_latest_per_key", "SELECT entity_id, predicate, object, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, predicate, object ORDER BY valid_from DESC, fact_id DESC) = 1", "facts")
def w5(w: World) -> DataFrame:
    return T.latest_per_key(w.facts, ["entity_id", "predicate", "object"]).select("entity_id", "predicate", "object", "fact_id")


@query("w6_freshness", f"SELECT entity_id, CAST(max(recorded_at) AS VARCHAR) AS last_recorded, CAST(max(valid_from) AS VARCHAR) AS last_valid_from FROM facts WHERE retracted_at IS NULL AND status <> 'competing' AND valid_from <= {NOW} AND (valid_until IS NULL OR valid_until > {NOW}) AND {LIVE} GROUP BY 1", "facts")
def w6(w: World) -> DataFrame:
    seen = T.freshness(T.current_facts(w.facts, NOW))
    return seen.select("entity_id", F.col("last_recorded").cast("string").alias("last_recorded"), F.col("last_valid_from").cast("string").alias("last_valid_from"))


@query("w9_update_history", """
WITH RECURSIVE walk AS (
 SELECT fact_id, fact_id AS here, 0 AS step FROM facts WHERE superseded_by IS NULL
 UNION ALL SELECT w.fact_id, f.fact_id, w.step + 1 FROM walk w JOIN facts f ON f.superseded_by = w.here WHERE w.step < 3)
SELECT fact_id, step, here AS old_id FROM walk WHERE step > 0""", "facts")
def w9(w: World) -> DataFrame:
    return T.update_history(w.facts).select("fact_id", "step", "old_id")


@query("w10_entity_timeline", """
SELECT entity_id, CAST(recorded_at AS VARCHAR) AS at, 'recorded' AS event, fact_id FROM facts
UNION ALL SELECT entity_id, CAST(retracted_at AS VARCHAR), 'retracted', fact_id FROM facts WHERE retracted_at IS NOT NULL""", "facts")
def w10(w: World) -> DataFrame:
    return T.entity_timeline(w.facts).withColumn("at", F.col("at").cast("string"))


@query("order_status_overview", """
WITH line AS (SELECT *, lead(valid_from) OVER (PARTITION BY entity_id, predicate ORDER BY valid_from, fact_id) AS ends FROM facts WHERE predicate = 'order_status')
SELECT object AS status, count(*) AS customers FROM line WHERE valid_from <= TIMESTAMP '1998-03-01 00:00:00' AND (ends IS NULL OR ends > TIMESTAMP '1998-03-01 00:00:00') GROUP BY 1""", "facts")
def overview(w: World) -> DataFrame:
    """Customers by order status as of a day: fact view, timeline, point in time, count."""
    line = T.timeline(w.facts.where("predicate = 'order_status'"), ["entity_id", "predicate"])
    return line.where(T.covers(F.expr(PAST))).groupBy(F.col("object").alias("status")).agg(F.count(F.lit(1)).alias("customers"))
