"""Queries over graph and resolution operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import graph as G
from factloom.operators import resolution as R
from factloom.operators import trust as T
from factloom.plans.catalog import NOW, World, query


def _seeds(w: World) -> DataFrame:
    """Ten queries over disjoint sets of customers and all suppliers."""
    customers = w.customer.selectExpr("c_custkey % 10 AS query_id", "concat('c', c_custkey) AS node", "1.0D + c_custkey % 3 AS score")
    suppliers = w.supplier.selectExpr("explode(sequence(0, 9)) AS query_id", "concat('s', s_suppkey) AS node", "0.5D AS score")
    return customers.union(suppliers)


@query("g1_personalized_pagerank")
def g1(w: World) -> DataFrame:
    ranks = G.personalized_pagerank(w.edges, _seeds(w))
    return ranks.select("query_id", "node", F.round("rank", 9).alias("rank"))


@query("g2_communities")
def g2(w: World) -> DataFrame:
    return G.communities(w.edges)


def _members(w: World, turn: int) -> DataFrame:
    return w.customer.selectExpr(f"CASE WHEN c_custkey % 100 = {turn} THEN 99 ELSE c_nationkey END AS community", "concat('c', c_custkey) AS node")


@query("g3_community_diff", """
WITH a AS (SELECT c_nationkey AS c, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS s FROM customer GROUP BY 1),
b AS (SELECT CASE WHEN c_custkey % 100 = 7 THEN 99 ELSE c_nationkey END AS c, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS s FROM customer GROUP BY 1)
SELECT coalesce(a.c, b.c) AS community, CASE WHEN b.s IS NULL THEN 'drop' ELSE 'rebuild' END AS change FROM a FULL JOIN b ON a.c = b.c WHERE a.s IS DISTINCT FROM b.s""")
def g3(w: World) -> DataFrame:
    return G.community_diff(_members(w, 1000), _members(w, 7))


@query("g3_community_diff_edges", """
WITH m AS (SELECT c_nationkey AS c, concat('c', c_custkey) AS node FROM customer),
e AS (SELECT src AS node, created_at, src, dst FROM edges UNION ALL SELECT dst, created_at, src, dst FROM edges),
a AS (SELECT c, max(created_at) AS at_ FROM m JOIN e USING (node) WHERE created_at < TIMESTAMP '1998-08-01 00:00:00' GROUP BY 1), b AS (SELECT c, max(created_at) AS at_ FROM m JOIN e USING (node) GROUP BY 1)
SELECT b.c AS community, 'rebuild' AS change FROM b LEFT JOIN a USING (c) WHERE a.at_ IS DISTINCT FROM b.at_""", "edges")
def g3b(w: World) -> DataFrame:
    """The same members, but some have edges since."""
    members = w.customer.selectExpr("c_nationkey AS community", "concat('c', c_custkey) AS node")
    return G.community_diff(members, members, w.edges.where("created_at < TIMESTAMP '1998-08-01 00:00:00'"), w.edges)


@query("g4_community_facts", """
SELECT c_nationkey AS community, row_number() OVER (PARTITION BY c_nationkey ORDER BY confidence DESC, valid_from DESC, fact_id)::INTEGER AS rank, fact_id
FROM facts JOIN customer ON entity_id = concat('c', c_custkey) WHERE status = 'active' AND retracted_at IS NULL QUALIFY rank <= 20""", "facts")
def g4b(w: World) -> DataFrame:
    return G.community_facts(w.customer.selectExpr("c_nationkey AS community", "concat('c', c_custkey) AS node"), w.facts)


@query("g4_community_profile", """
WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
m AS (SELECT c_nationkey AS community, concat('c', c_custkey) AS node, c_name AS name FROM customer)
SELECT community, count(*) AS size, arg_min(name, r) AS label FROM (SELECT m.*, row_number() OVER (PARTITION BY community ORDER BY degree DESC NULLS LAST, m.node) AS r FROM m LEFT JOIN d USING (node)) GROUP BY 1""", "edges")
def g4(w: World) -> DataFrame:
    members = w.customer.selectExpr("c_nationkey AS community", "concat('c', c_custkey) AS node")
    return G.community_profile(members, w.edges, w.customer.selectExpr("concat('c', c_custkey) AS node", "c_name AS name"))


@query("g5_merge_identities", """
WITH RECURSIVE l AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 WHEN c_custkey % 50 = 48 THEN c_custkey + 1 ELSE c_custkey // 3 END AS into_ FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 50 IN (48, 49)),
walk AS (SELECT node, into_ AS at_, 1 AS h FROM l WHERE node <> into_ UNION ALL SELECT w.node, l.into_, h + 1 FROM walk w JOIN l ON w.at_ = l.node AND l.node <> l.into_ WHERE h < 40),
ends AS (SELECT node, arg_max(at_, h) AS at_, max(h) AS h FROM walk GROUP BY 1)
SELECT node, CASE WHEN h < 40 THEN at_ END AS survivor, CASE WHEN h < 40 THEN 'merged' ELSE 'cycle' END AS status FROM ends""")
def g5(w: World) -> DataFrame:
    links = w.customer.where("c_custkey % 5 <> 0 OR c_custkey % 50 IN (48, 49)").selectExpr(
        "c_custkey AS node", "CASE WHEN c_custkey % 50 = 49 THEN c_custkey - 1 WHEN c_custkey % 50 = 48 THEN c_custkey + 1 ELSE c_custkey DIV 3 END AS merged_into"
    )
    return G.merge_identities(links).withColumn("survivor", F.when(F.col("status") == "merged", F.col("survivor")))


CLOSURE = """reach AS (SELECT fact_id FROM links WHERE parent IN (SELECT fact_id FROM facts WHERE n % 500 = 3)
 UNION SELECT l.fact_id FROM links l JOIN reach r ON l.parent = r.fact_id)"""


@query("g6_derived_closure", f"WITH RECURSIVE {CLOSURE} SELECT fact_id FROM reach WHERE fact_id NOT IN (SELECT fact_id FROM facts WHERE n % 500 = 3)", "facts links")
def g6(w: World) -> DataFrame:
    return G.derived_closure(w.links, w.facts.where("n % 500 = 3"))


@query("g6_cascade_retract", f"""WITH RECURSIVE {CLOSURE} SELECT CASE WHEN retracted_at IS NULL AND (n % 500 = 3 OR fact_id IN (SELECT fact_id FROM reach)) THEN 'retracted' ELSE status END AS status, count(*) AS n FROM facts GROUP BY 1""", "facts links")
def g6b(w: World) -> DataFrame:
    return G.cascade_retract(w.facts, w.links, w.facts.where("n % 500 = 3"), F.expr(NOW), "cascade").groupBy("status").agg(F.count("*").alias("n"))


@query("g6_mark_stale", f"WITH RECURSIVE {CLOSURE} SELECT count(*) AS stale FROM facts WHERE fact_id IN (SELECT fact_id FROM reach) AND n % 500 <> 3", "facts links")
def g6c(w: World) -> DataFrame:
    return G.mark_stale(w.facts, w.links, w.facts.where("n % 500 = 3"), F.expr(NOW)).agg(F.count("stale_at").alias("stale"))


@query("g7_expand_edges", """
WITH b AS (SELECT c_nationkey AS query_id, concat('c', c_custkey) AS entity_id, c_acctbal AS rank_score FROM customer),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, entity_id) <= 3),
f AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
r AS (SELECT t.query_id, t.entity_id AS seed, f.dst AS entity_id, 0.5 * rank_score * weight AS score FROM t JOIN f ON t.entity_id = f.src WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query_id = t.query_id AND b.entity_id = f.dst)
 QUALIFY row_number() OVER (PARTITION BY t.query_id, t.entity_id ORDER BY score DESC, f.dst) <= 5)
SELECT query_id, entity_id, round(max(score), 6) AS score FROM r GROUP BY 1, 2""", "edges")
def g7(w: World) -> DataFrame:
    buckets = w.customer.selectExpr("c_nationkey AS query_id", "concat('c', c_custkey) AS entity_id", "c_acctbal AS rank_score")
    return G.expand_edges(buckets, w.edges, 0.5).withColumn("score", F.round("score", 6))


@query("g8_graph_retrieve", """
WITH ent AS (SELECT entity_id, canonical_name, n FROM entities UNION ALL SELECT concat('s', s_suppkey), s_name, s_suppkey FROM supplier),
q AS (SELECT a.entity_id AS query_id, b.entity_id, 1.0 AS e FROM ent a JOIN ent b ON lower(a.canonical_name) = lower(b.canonical_name) WHERE a.n % 50 = 0),
f AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
nodes AS (SELECT query_id, entity_id, max(e) AS e FROM (SELECT * FROM q UNION ALL SELECT q.query_id, f.dst, 0.7 FROM q JOIN f ON q.entity_id = f.src) GROUP BY 1, 2),
l AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, predicate, object ORDER BY valid_from DESC, fact_id DESC) = 1)
SELECT query_id, l.entity_id, fact_id, round((e * CASE WHEN predicate = 'phone' THEN 1 ELSE 0.5 END)::DOUBLE, 6) AS score FROM nodes JOIN l USING (entity_id) WHERE e = 1 OR predicate = 'phone'""", "facts entities edges")
def g8(w: World) -> DataFrame:
    """Customers and suppliers by name; a supplier's neighbours are its customers, who have the facts."""
    known = w.entities.select("entity_id", "canonical_name", "n").unionByName(w.supplier.selectExpr("concat('s', s_suppkey) AS entity_id", "s_name AS canonical_name", "s_suppkey AS n"))
    names = known.where("n % 50 = 0").selectExpr("entity_id AS query_id", "upper(canonical_name) AS name")
    return G.graph_retrieve(names, known, w.edges, w.facts, ["phone"]).withColumn("score", F.round("score", 6))


@query("g10_alias_union", """
WITH RECURSIVE c AS (SELECT p_partkey AS id, concat('n', p_partkey % 900) AS a, concat('n', p_partkey * 7 % 300) AS b FROM part),
e AS (SELECT a, b FROM c UNION SELECT b, a FROM c UNION SELECT a, a FROM c), reach AS (SELECT a AS node, b AS r FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT id AS candidate_id, concat('p|', min(r)) AS root FROM c JOIN reach ON c.a = reach.node GROUP BY 1""")
def g10(w: World) -> DataFrame:
    candidates = w.part.selectExpr("p_partkey AS candidate_id", "'p' AS type", "concat(' N', p_partkey % 900) AS name", "concat('n', p_partkey * 7 % 300, ' ') AS canonical")
    return G.alias_union(candidates)


def _incoming(w: World) -> DataFrame:
    """Facts of the view with semantics from the registry, learned trust and a vector of their object."""
    trust = T.refit_source_trust(T.trust_events(w.facts))
    rows = w.facts.withColumns({
        "source_key": T.source_key(F.col("vertical"), F.col("recorder")), "domain": F.col("predicate"), "declared_trust": T.declared_trust(F.col("vertical")),
        "authority": F.lit(0.0), "embedding": F.expr("transform(array('F', 'O', 'P'), x -> CAST(x = object AS DOUBLE))"),
    })
    known = T.trust_lookup(rows, trust).withColumnRenamed("learned", "learned_trust")
    return known.join(w.registry.select("predicate", "semantics"), "predicate").where("semantics <> 'append_only'")


@query("res1_resolve_facts")
def res1(w: World) -> DataFrame:
    out = R.resolve_facts(_incoming(w), "1999-06-01")
    return out.select("fact_id", "outcome", "status", "superseded_by", "corroborates", F.col("valid_until").cast("string").alias("valid_until"))


@query("res3_single_active", f"""
WITH RECURSIVE f AS (SELECT fact_id, entity_id, user_id, derived_version, object, origin_key, valid_from, valid_until, row_number() OVER slot AS k
 FROM facts WHERE predicate = 'order_status' AND retracted_at IS NULL WINDOW slot AS (PARTITION BY entity_id, user_id, derived_version ORDER BY recorded_at, fact_id)),
walk AS (SELECT *, fact_id AS a, object AS ao, origin_key AS ag, valid_from AS av, 'INSERTED' AS outcome, NULL::VARCHAR AS other, NULL::VARCHAR AS closes FROM f WHERE k = 1
 UNION ALL SELECT s.fact_id, s.entity_id, s.user_id, s.derived_version, s.object, s.origin_key, s.valid_from, s.valid_until, s.k, CASE WHEN t THEN s.fact_id ELSE a END, CASE WHEN t THEN s.object ELSE ao END, CASE WHEN t THEN s.origin_key ELSE ag END, CASE WHEN t THEN s.valid_from ELSE av END,
  CASE WHEN c THEN 'CORROBORATED' WHEN t THEN 'SUPERSEDED' ELSE 'INSERTED_HISTORICAL' END, CASE WHEN NOT t THEN a END, CASE WHEN t THEN a END
 FROM (SELECT f.*, w.a, w.ao, w.ag, w.av, f.object = w.ao AND f.origin_key IS DISTINCT FROM w.ag AS c, NOT (f.object = w.ao AND f.origin_key IS DISTINCT FROM w.ag) AND f.valid_from >= w.av AS t
  FROM walk w JOIN f ON f.k = w.k + 1 AND f.entity_id = w.entity_id AND f.user_id IS NOT DISTINCT FROM w.user_id AND f.derived_version IS NOT DISTINCT FROM w.derived_version) s),
gone AS (SELECT closes, fact_id, valid_from FROM walk WHERE closes IS NOT NULL)
SELECT w.fact_id, w.outcome, CASE w.outcome WHEN 'CORROBORATED' THEN 'corroborating' WHEN 'INSERTED_HISTORICAL' THEN 'superseded' ELSE CASE WHEN g.fact_id IS NULL THEN 'active' ELSE 'superseded' END END AS status,
 CASE WHEN w.outcome = 'INSERTED_HISTORICAL' THEN other ELSE g.fact_id END AS superseded_by, CASE WHEN w.outcome = 'CORROBORATED' THEN other END AS corroborates,
 CAST(CASE WHEN w.outcome = 'INSERTED_HISTORICAL' THEN av WHEN g.fact_id IS NOT NULL THEN g.valid_from ELSE w.valid_until END AS VARCHAR) AS valid_until
FROM walk w LEFT JOIN gone g ON g.closes = w.fact_id""", "facts")
def res3(w: World) -> DataFrame:
    out = R.resolve_facts(_incoming(w).where("semantics = 'single_active'"), "1999-06-01")
    return out.select("fact_id", "outcome", "status", "superseded_by", "corroborates", F.col("valid_until").cast("string").alias("valid_until"))


@query("res2_append_only", """
WITH f AS (SELECT * FROM facts WHERE predicate = 'summary_profile' AND retracted_at IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id, user_id, derived_version, object ORDER BY recorded_at, fact_id) AS k FROM f),
-- A fact is active unless an earlier active one has another origin: that is, unless the first fact of its group has another origin.
told AS (SELECT r.*, r.origin_key IS NOT DISTINCT FROM s.origin_key AS active FROM ranked r JOIN ranked s ON s.k = 1 AND r.entity_id = s.entity_id AND r.object = s.object
  AND r.user_id IS NOT DISTINCT FROM s.user_id AND r.derived_version IS NOT DISTINCT FROM s.derived_version)
SELECT a.fact_id, CASE WHEN max(b.k) IS NULL THEN 'INSERTED' ELSE 'CORROBORATED' END AS outcome, arg_max(b.fact_id, b.k) AS corroborates
FROM told a LEFT JOIN told b ON b.active AND b.k < a.k AND a.origin_key IS DISTINCT FROM b.origin_key AND a.entity_id = b.entity_id AND a.object = b.object
  AND a.user_id IS NOT DISTINCT FROM b.user_id AND a.derived_version IS NOT DISTINCT FROM b.derived_version
GROUP BY a.fact_id""", "facts")
def res2(w: World) -> DataFrame:
    return R.append_only(w.facts.where("predicate = 'summary_profile'").drop("status")).select("fact_id", "outcome", "corroborates")


@query("res4_resolve_bitemporal")
def res4(w: World) -> DataFrame:
    return A.ingest_outcomes(R.resolve_facts(_incoming(w).where("semantics = 'bitemporal'"), "1999-06-01"))


@query("res5_resolve_events")
def res5(w: World) -> DataFrame:
    return A.ingest_outcomes(R.resolve_facts(_incoming(w).withColumn("semantics", F.lit("events")), "1999-06-01"))


@query("res6_explain_conflicts")
def res6(w: World) -> DataFrame:
    rows = _incoming(w)
    return R.explain_conflicts(R.resolve_facts(rows, "1999-06-01"), rows).withColumn("margin", F.round("margin", 6))


@query("res7_predict_outcomes")
def res7(w: World) -> DataFrame:
    rows = _incoming(w)
    return R.predict_outcomes(rows.where("n % 10 <> 4"), rows.where("n % 10 = 4"), "1999-06-01").select("fact_id", "outcome")


@query("res8_retract", f"""
WITH RECURSIVE hit AS (SELECT fact_id FROM facts WHERE n % 40 = 9 AND retracted_at IS NULL),
down AS (SELECT l.fact_id FROM links l JOIN hit h ON l.parent = h.fact_id JOIN facts f ON f.fact_id = l.fact_id AND f.retracted_at IS NULL
 UNION SELECT l.fact_id FROM down d JOIN links l ON l.parent = d.fact_id JOIN facts f ON f.fact_id = l.fact_id AND f.retracted_at IS NULL),
r AS (SELECT f.*, f.fact_id IN (FROM hit) AS h, f.fact_id IN (FROM down) AS d, coalesce(f.superseded_by IN (FROM hit), false) AND status = 'superseded' AS b FROM facts f)
SELECT fact_id, CASE WHEN h OR d THEN 'retracted' WHEN b THEN 'active' ELSE status END AS status, CASE WHEN h THEN 'wrong' WHEN d THEN 'parent retracted: wrong' END AS reason,
 CAST(CASE WHEN h OR d THEN {NOW} ELSE retracted_at END AS VARCHAR) AS retracted_at,
 CAST(CASE WHEN h THEN coalesce(valid_until, {NOW}) WHEN d THEN {NOW} WHEN b THEN prior_valid_until ELSE valid_until END AS VARCHAR) AS valid_until FROM r""", "facts links")
def res8(w: World) -> DataFrame:
    out = R.retract(w.facts, w.facts.where("n % 40 = 9"), w.links, F.expr(NOW).cast("timestamp_ntz"), "wrong")
    text = {c: F.col(c).cast("string") for c in ("retracted_at", "valid_until")}
    return out.select("fact_id", "status", F.col("retraction_reason").alias("reason"), *(c.alias(n) for n, c in text.items()))


@query("res9_apply_corroboration", """
WITH p AS (SELECT fact_id AS younger, lag(fact_id) OVER (PARTITION BY entity_id, predicate, object ORDER BY recorded_at, fact_id) AS elder, origin_key FROM facts),
o AS (SELECT elder, count(DISTINCT origin_key) AS c FROM p WHERE elder IS NOT NULL GROUP BY 1)
SELECT fact_id, CASE WHEN p.elder IS NOT NULL THEN 'corroborating' ELSE status END AS status, c AS origin_count FROM facts LEFT JOIN p ON fact_id = younger LEFT JOIN o ON fact_id = o.elder""", "facts")
def res9(w: World) -> DataFrame:
    from pyspark.sql import Window as W

    elder = F.lag("fact_id").over(W.partitionBy("entity_id", "predicate", "object").orderBy("recorded_at", "fact_id"))
    pairs = w.facts.select(F.col("fact_id").alias("younger"), elder.alias("elder")).where("elder IS NOT NULL")
    return R.apply_corroboration(w.facts, pairs).select("fact_id", "status", "origin_count")


#: Candidates of the customers' facts: some of no known customer, some without a predicate or an object, and objects with blanks.
STAGED = "SELECT fact_id AS candidate_id, CASE WHEN n % 31 = 0 THEN 'nobody' ELSE entity_id END AS subject, CASE WHEN n % 37 = 0 THEN NULL ELSE predicate END AS predicate, CASE WHEN n % 41 = 0 THEN NULL WHEN n % 2 = 0 THEN concat('  ', object, '  x ') ELSE concat(object, ' x') END AS object, confidence FROM facts"
RELATED = "SELECT concat(src, dst) AS candidate_id, src AS from_id, CASE WHEN weight > 0.9e0 THEN 'c1' ELSE concat('c', CAST(substr(dst, 2) AS INT)) END AS to_id, kind, CAST(weight AS DOUBLE) AS confidence FROM edges"
ROOTS = "SELECT concat('c', c_custkey) AS candidate_id, c_nationkey AS root FROM customer"


@query("res10_merge_candidates", f"""
WITH s AS ({STAGED}), r AS ({ROOTS}), p AS (SELECT s.*, r.root AS entity, regexp_replace(trim(object), '\\s+', ' ', 'g') AS same FROM s JOIN r ON subject = r.candidate_id WHERE predicate IS NOT NULL AND object IS NOT NULL)
SELECT entity, predicate, arg_min(object, struct_pack(a := -confidence, b := candidate_id)) AS object, max(confidence) AS confidence, arg_min(candidate_id, struct_pack(a := -confidence, b := candidate_id)) AS leader, count(*) AS contributors
FROM p GROUP BY entity, predicate, same""", "facts")
def res10(w: World) -> DataFrame:
    return R.merge_candidates(_staged(w), _roots(w))


@query("res10_merge_relations", f"""
WITH l AS ({RELATED}), r AS ({ROOTS})
SELECT a.root AS src, b.root AS dst, kind, max(confidence) AS confidence, min(l.candidate_id) AS leader, count(*) AS contributors FROM l JOIN r a ON from_id = a.candidate_id JOIN r b ON to_id = b.candidate_id
WHERE a.root <> b.root GROUP BY 1, 2, 3""", "edges")
def res10_relations(w: World) -> DataFrame:
    return R.merge_relations(_related(w), _roots(w))


@query("res10_rejected", f"""
WITH s AS ({STAGED}), l AS ({RELATED}), r AS ({ROOTS})
SELECT s.candidate_id, 'fact' AS kind, CASE WHEN r.root IS NULL THEN 'orphan_entity' ELSE 'malformed_fact' END AS reason FROM s LEFT JOIN r ON subject = r.candidate_id WHERE r.root IS NULL OR predicate IS NULL OR object IS NULL
UNION ALL SELECT l.candidate_id, 'relation', 'orphan_relation' FROM l LEFT JOIN r a ON from_id = a.candidate_id LEFT JOIN r b ON to_id = b.candidate_id WHERE a.root IS NULL OR b.root IS NULL OR a.root = b.root""", "facts edges")
def res10_rejected(w: World) -> DataFrame:
    return R.rejected_candidates(_staged(w), _related(w), _roots(w))


def _staged(w: World) -> DataFrame:
    return w.spark.sql(STAGED.replace("FROM facts", "FROM {facts}"), facts=w.facts)


def _related(w: World) -> DataFrame:
    return w.spark.sql(RELATED.replace("FROM edges", "FROM {edges}"), edges=w.edges)


def _roots(w: World) -> DataFrame:
    return w.spark.sql(ROOTS.replace("FROM customer", "FROM {customer}"), customer=w.customer)


@query("res11_refresh_summaries", """
WITH RECURSIVE lk AS (SELECT fact_id, parent FROM links UNION SELECT fact_id, concat('o', n + 2) FROM facts WHERE n % 16 = 1),
walk AS (SELECT l.fact_id, l.parent, l.parent AS at_, 0 AS h FROM lk l JOIN facts f ON l.fact_id = f.fact_id WHERE f.n % 8 = 1
 UNION ALL SELECT w.fact_id, w.parent, f.superseded_by, h + 1 FROM walk w JOIN facts f ON f.fact_id = w.at_ JOIN facts g ON g.fact_id = f.superseded_by WHERE h < 8),
last_ AS (SELECT fact_id, arg_max(at_, h) AS at_ FROM walk GROUP BY fact_id, parent),
b AS (SELECT last_.fact_id, count(*) AS n, avg(confidence) AS confidence, string_agg(object, '; ' ORDER BY valid_from, at_) AS text, min(valid_from) AS valid_from, string_agg(at_, ',' ORDER BY valid_from, at_) AS derived_from,
 arg_max(coalesce(valid_until, valid_from), struct_pack(a := valid_from, b := at_)) AS valid_until FROM last_ JOIN facts p ON p.fact_id = at_ AND p.retracted_at IS NULL GROUP BY 1)
SELECT s.fact_id, coalesce(b.n, 0) AS n, text, round(b.confidence, 9) AS confidence, CAST(b.valid_from AS VARCHAR) AS valid_from, CAST(b.valid_until AS VARCHAR) AS valid_until, derived_from
FROM facts s LEFT JOIN b ON b.fact_id = s.fact_id WHERE s.n % 8 = 1""", "facts links")
def res11(w: World) -> DataFrame:
    links = w.links.unionByName(w.facts.where("n % 16 = 1").selectExpr("fact_id", "concat('o', n + 2) AS parent"))
    made = R.refresh_summaries(w.facts.where("n % 8 = 1"), links, w.facts)
    return made.select("fact_id", "n", "text", F.round("confidence", 9).alias("confidence"), F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_until"), F.array_join("derived_from", ",").alias("derived_from"))


@query("res12_artifacts", """
SELECT entity_id, coalesce(string_agg(object, ', ' ORDER BY valid_from DESC, fact_id DESC) FILTER (WHERE predicate = 'phone'), '') AS phone, coalesce(string_agg(object, ', ' ORDER BY valid_from DESC, fact_id DESC) FILTER (WHERE predicate = 'order_status'), '') AS order_status,
 entity_id IN (SELECT entity_id FROM facts WHERE n % 90 = 2) AS dirty FROM facts WHERE status = 'active' GROUP BY 1""", "facts")
def res12(w: World) -> DataFrame:
    return R.artifact_invalidation(R.build_artifacts(w.facts, ["phone", "order_status"]), w.facts.where("n % 90 = 2"))


TEMPLATES = {
    "building": [("Status", "order_status", "latest"), ("Phones", "phone", "list")],
    "machinery": [("Orders", "order_status", "count"), ("Phone", "phone", "latest"), ("Notes", "summary_profile", "list")],
}


@query("res12_compile_artifacts", """
WITH o AS (SELECT entity_id, predicate, string_agg(object, ', ' ORDER BY valid_from DESC, fact_id DESC) AS l, arg_max(object, struct_pack(a := valid_from, b := fact_id)) AS t, count(*) AS c FROM facts WHERE status = 'active' GROUP BY 1, 2)
SELECT e.entity_id, type, CASE type WHEN 'building' THEN concat_ws(chr(10), 'Status: ' || s.t, 'Phones: ' || p.l) ELSE concat_ws(chr(10), 'Orders: ' || s.c, 'Phone: ' || p.t, 'Notes: ' || n.l) END AS text
FROM entities e LEFT JOIN o s ON s.entity_id = e.entity_id AND s.predicate = 'order_status' LEFT JOIN o p ON p.entity_id = e.entity_id AND p.predicate = 'phone' LEFT JOIN o n ON n.entity_id = e.entity_id AND n.predicate = 'summary_profile'
WHERE type IN ('building', 'machinery')""", "facts entities")
def res12_compile(w: World) -> DataFrame:
    return R.compile_artifacts(w.facts, w.entities, TEMPLATES)


@query("res13_propositions_to_facts", """
WITH t AS (SELECT user_id AS s, event_id // 37 AS i, min(ts) AS at_, min(user_id % 7) AS u FROM events GROUP BY 1, 2), m AS (SELECT s, min(at_) AS a FROM t GROUP BY 1),
p AS (SELECT event_id, user_id AS s, event_id // 37 AS i, (event_id * 3) // 111 + event_id % 5 // 4 * 9000 AS j, CASE WHEN event_id % 3 = 0 THEN '2024-02-03' ELSE 'soon' END AS d FROM events WHERE event_id % 20 IN (3, 4))
SELECT event_id AS prop_id, CASE WHEN d = 'soon' THEN epoch_us(a) ELSE epoch_us(TIMESTAMP '2024-02-03 00:00:00') END AS valid_from FROM p JOIN m USING (s) WHERE EXISTS (SELECT 1 FROM t WHERE t.s = p.s AND t.i = p.i) AND EXISTS (SELECT 1 FROM t WHERE t.s = p.s AND t.i = p.j)""")
def res13(w: World) -> DataFrame:
    turns = w.events.groupBy(F.col("user_id").alias("session_id"), F.expr("event_id DIV 37 AS turn_index")).agg(F.min("ts").alias("occurred_at"), F.min(F.expr("user_id % 7")).alias("user_id"))
    props = w.events.where("event_id % 20 IN (3, 4)").selectExpr("event_id AS prop_id", "user_id AS session_id", "'s' AS subject", "'p' AS predicate", "'o' AS object",
        "CASE WHEN event_id % 3 = 0 THEN '2024-02-03' ELSE 'soon' END AS date_text", "array(event_id DIV 37, (event_id * 3) DIV 111 + event_id % 5 DIV 4 * 9000) AS turn_indexes")
    return R.propositions_to_facts(props, turns).select("prop_id", F.unix_micros("valid_from").alias("valid_from"))
