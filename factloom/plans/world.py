"""Queries over joins, policies, trust, aggregates and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import joins as J
from factloom.operators import policy as P
from factloom.operators import sessions as S
from factloom.operators import trust as T
from factloom.plans.catalog import NOW, World, query



def _now() -> Column:
    return F.expr(NOW)

CUT = "TIMESTAMP '1998-06-01 00:00:00'"
EPISODES = "array(concat('t', CAST(n % 997 AS STRING)), concat('t', CAST(n * 7 % 997 AS STRING)))"


@query("j1_reattribute_merged", """
WITH r AS (SELECT coalesce(l.merged_into, f.entity_id) AS entity_id, coalesce(l.external_ref, s.external_ref) AS crm, coalesce(CASE WHEN l.n % 3 = 0 THEN l.type END, CASE WHEN s.n % 3 = 0 THEN s.type END) AS kind
 FROM facts f LEFT JOIN entities l ON f.entity_id = l.entity_id AND l.merged_into IS NOT NULL
 LEFT JOIN entities s ON s.entity_id = coalesce(l.merged_into, f.entity_id) WHERE l.entity_id IS NULL OR s.entity_id IS NOT NULL)
SELECT entity_id, count(*) AS n, min(crm) AS least, max(crm) AS most, count(kind) AS kinds, min(kind) AS kind FROM r GROUP BY 1""", "facts entities")
def j1(w: World) -> DataFrame:
    """Entities with two kinds of references, of which a third have both."""
    entities = w.entities.withColumn("external_refs", F.create_map(F.lit("crm"), "external_ref", F.lit("kind"), F.expr("CASE WHEN n % 3 = 0 THEN type END")))
    crm, kind = F.col("refs")["crm"], F.col("refs")["kind"]
    return J.reattribute_merged(w.facts, entities).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min(crm).alias("least"), F.max(crm).alias("most"), F.count(kind).alias("kinds"), F.min(kind).alias("kind"))


@query("j2_resolve_refs", """
SELECT o_orderkey, e.entity_id FROM orders LEFT JOIN entities e ON replace(concat('crm', '__', o_custkey % 2000), '.', '__') = e.external_ref""", "entities")
def j2(w: World) -> DataFrame:
    rows = w.orders.select("o_orderkey", F.lit("crm").alias("vertical"), (F.col("o_custkey") % 2000).cast("string").alias("id"))
    return J.resolve_refs(rows, w.entities.select(F.col("external_ref").alias("key"), "entity_id")).select("o_orderkey", "entity_id")


@query("j3_neighbours", """
WITH seeds AS (SELECT DISTINCT entity_id FROM entities WHERE n % 10 = 1 UNION SELECT concat('s', s_suppkey) FROM supplier WHERE s_suppkey % 10 = 1)
SELECT entity_id AS seed, dst AS peer, 'out' AS direction FROM edges JOIN seeds ON src = entity_id
UNION ALL SELECT entity_id, src, 'in' FROM edges JOIN seeds ON dst = entity_id""", "entities edges")
def j3(w: World) -> DataFrame:
    seeds = w.entities.where("n % 10 = 1").select("entity_id").union(w.supplier.where("s_suppkey % 10 = 1").selectExpr("concat('s', s_suppkey)"))
    return J.neighbours(w.edges, seeds).select("seed", "peer", "direction")


@query("j9_provenance", """
WITH cited AS (SELECT DISTINCT fact_id, unnest([concat('t', n % 997), concat('t', n * 7 % 997)]) AS turn_id FROM facts)
SELECT fact_id, row_number() OVER (PARTITION BY fact_id ORDER BY occurred_at, turn_id) AS seq, turn_id, substr(text, 1, 600) AS text FROM cited JOIN turns USING (turn_id)""", "facts turns")
def j9(w: World) -> DataFrame:
    return J.provenance(w.facts.withColumn("episode_ids", F.expr(EPISODES)), w.turns)


@query("j11_orphans", """
SELECT entity_id FROM entities WHERE merged_into IS NULL AND entity_id NOT IN (SELECT entity_id FROM facts WHERE status = 'active')""", "facts entities")
def j11(w: World) -> DataFrame:
    return J.orphans(w.entities, w.facts).select("entity_id")


@query("j12_origin_docs", "SELECT fact_id, doc_id FROM facts JOIN documents ON substr(origin_key, 5) = CAST(doc_id AS VARCHAR)", "facts")
def j12(w: World) -> DataFrame:
    return J.origin_docs(w.facts, w.documents.select(F.col("doc_id").cast("string").alias("hash"), "doc_id"))


@query("j13_hydrate", "SELECT type, count(*) AS n FROM facts LEFT JOIN entities USING (entity_id) GROUP BY 1", "facts entities")
def j13(w: World) -> DataFrame:
    return J.hydrate(w.facts, w.entities).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


SETS = [
    {"name": "privacy", "mode": "enforce", "default": "allow", "rules": [
        {"id": "no-phone", "effect": "deny", "when": [("predicate", "eq", "phone"), ("confidence", "lt", 0.5)]},
        {"id": "own-world", "effect": "deny", "when": [("derived_version", "exists", None), ("vertical", "in", ["message"])]}]},
    {"name": "trial", "mode": "report_only", "default": "deny", "rules": [
        {"id": "known-lang", "effect": "allow", "when": [("lang", "exists", None)]},
        {"id": "urgent", "effect": "deny", "when": [("recorder", "prefix", "1-")]}]},
]
PRIV = "CASE WHEN predicate = 'phone' AND confidence < 0.5 THEN 'no-phone' WHEN derived_version IS NOT NULL AND vertical = 'message' THEN 'own-world' END"
TRIAL = "CASE WHEN starts_with(recorder, '1-') THEN 'urgent' WHEN lang IS NOT NULL THEN NULL ELSE 'default' END"


@query("f15_apply_policy", f"""
SELECT fact_id, CASE WHEN p IS NOT NULL THEN 'deny' WHEN t IS NOT NULL THEN 'would_deny' ELSE 'allow' END AS decision,
  CASE WHEN p IS NOT NULL THEN p WHEN t = 'urgent' THEN t END AS rule_id
FROM (SELECT fact_id, {PRIV} AS p, {TRIAL} AS t FROM facts)""", "facts")
def f15(w: World) -> DataFrame:
    return P.apply_policy(w.facts, SETS).select("fact_id", "decision", "rule_id")


@query("f16_policy_meta_union", """
WITH bad AS (SELECT concat('doc:', doc_id) AS k FROM documents WHERE lang = 'fr' AND n_chars < 1500)
SELECT fact_id FROM facts WHERE origin_key NOT IN (SELECT k FROM bad) AND concat('doc:', (n * 3) % 997) NOT IN (SELECT k FROM bad)""", "facts")
def f16(w: World) -> DataFrame:
    facts = w.facts.withColumn("origin_keys", F.expr("array(origin_key, concat('doc:', CAST(n * 3 % 997 AS STRING)))"))
    rule = {"id": "short", "effect": "deny", "when": [("lang", "eq", "fr"), ("n_chars", "lt", 1500)]}
    docs = w.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("origin_key"), "lang", "n_chars")
    return P.policy_meta_union(facts, docs, [{"name": "meta", "mode": "enforce", "default": "allow", "rules": [rule]}]).select("fact_id")


@query("a11_policy_impact", f"""
WITH v AS (SELECT fact_id, 'privacy' AS policy_set, {PRIV} AS rule FROM facts UNION ALL SELECT fact_id, 'trial', {TRIAL} FROM facts),
r AS (SELECT policy_set, rule, row_number() OVER (PARTITION BY policy_set ORDER BY rule) AS k FROM (SELECT DISTINCT policy_set, CASE rule WHEN 'default' THEN 'posture' ELSE rule END AS rule FROM v WHERE rule IS NOT NULL)),
s AS (SELECT policy_set, fact_id, row_number() OVER (PARTITION BY policy_set ORDER BY fact_id) AS k FROM v WHERE rule IS NOT NULL),
n AS (SELECT policy_set, count(*) AS total, count(rule) AS no FROM v GROUP BY 1)
SELECT policy_set, total, CASE policy_set WHEN 'privacy' THEN no ELSE 0 END AS denied, CASE policy_set WHEN 'trial' THEN no ELSE 0 END AS would_deny,
 (SELECT string_agg(rule, ',' ORDER BY rule) FROM r WHERE r.policy_set = n.policy_set AND k <= 3) AS rule_ids,
 (SELECT string_agg(fact_id, ',' ORDER BY fact_id) FROM s WHERE s.policy_set = n.policy_set AND k <= 3) AS sample_fact_ids FROM n""", "facts")
def a11(w: World) -> DataFrame:
    return P.policy_impact(w.facts, SETS).withColumns({c: F.array_join(c, ",") for c in ("rule_ids", "sample_fact_ids")})


@query("a11_preview_rule", f"""
WITH f AS (SELECT * FROM facts WHERE status = 'active' AND retracted_at IS NULL ORDER BY recorded_at DESC, fact_id DESC LIMIT 1000),
m AS (SELECT *, row_number() OVER (ORDER BY recorded_at DESC, fact_id DESC) AS k FROM f WHERE vertical IN ('billing'))
SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM f) AS sampled, (SELECT string_agg(fact_id, ',' ORDER BY k) FROM m WHERE k <= 3) AS sample""", "facts")
def a11_preview(w: World) -> DataFrame:
    out = P.preview_rule(w.facts, {"id": "r", "effect": "deny", "when": [("vertical", "in", ["billing"])]})
    return out.withColumn("sample", F.array_join(F.transform("sample", lambda f: f["fact_id"]), ","))


@query("a1_stats_overview", f"""
SELECT count(*) AS facts, count_if(status = 'active') AS active, count_if(status = 'superseded') AS superseded, count_if(status = 'retracted') AS retracted,
 count_if(status = 'competing') AS competing, count(DISTINCT entity_id) AS entities, count_if(recorded_at > {NOW} - INTERVAL 7 DAY AND recorded_at <= {NOW}) AS last_week FROM facts""", "facts")
def a1(w: World) -> DataFrame:
    return A.stats_overview(w.facts, _now())


@query("a2_memory_quality", f"""
SELECT count_if(status = 'active' AND recorded_at < {NOW} - INTERVAL 30 DAY) AS older_30, count_if(status = 'active' AND recorded_at < {NOW} - INTERVAL 90 DAY) AS older_90,
 count_if(status = 'active' AND recorded_at < {NOW} - INTERVAL 365 DAY) AS older_365, count_if(status = 'active' AND confidence < 0.4) AS low,
 count_if(status = 'active' AND confidence > 0.6) AS high, count_if(status = 'active' AND confidence BETWEEN 0.4 AND 0.6) AS neutral,
 (SELECT count(*) FROM entities WHERE merged_into IS NULL AND entity_id NOT IN (SELECT entity_id FROM facts WHERE status = 'active')) AS orphans FROM facts""", "facts entities")
def a2(w: World) -> DataFrame:
    return A.memory_quality(w.facts.withColumn("trust", F.col("confidence")), w.entities, _now())


EVENTS_SQL = """
events_ AS (SELECT concat(vertical, ':', coalesce(recorder, '_')) AS source_key, predicate AS domain, CASE WHEN status IN ('active', 'corroborating') THEN 1 ELSE 0 END AS win,
  CASE WHEN status IN ('superseded', 'retracted') THEN 1 ELSE 0 END AS loss, recorded_at,
  CASE WHEN status = 'corroborating' THEN row_number() OVER (PARTITION BY status, vertical, recorder, predicate, origin_key ORDER BY recorded_at, fact_id) ELSE 1 END AS nth FROM facts),
ev AS (SELECT * FROM events_ WHERE nth = 1),
trust AS (SELECT source_key, domain, sum(win) AS wins, sum(loss) AS losses, sum(win + loss) AS samples, max(recorded_at) AS last_seen, sum(win) / sum(win + loss) AS rate
  FROM ev GROUP BY GROUPING SETS ((source_key, domain), (source_key)) HAVING sum(win + loss) > 0)"""


@query("a3_trust_events", f"WITH {EVENTS_SQL} SELECT source_key, domain, sum(win)::BIGINT AS win, sum(loss)::BIGINT AS loss, count(*) AS n FROM ev GROUP BY 1, 2", "facts")
def a3(w: World) -> DataFrame:
    return T.trust_events(w.facts).groupBy("source_key", "domain").agg(F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("n"))


@query("a4_feedback_events", """
SELECT source_key, domain, count_if(verdict = 'helpful') AS wins, count_if(verdict = 'incorrect') AS losses FROM (
 SELECT DISTINCT user_id % 5 AS actor, concat('e', user_id % 11) AS source_key, concat('d', event_id % 3) AS domain, CASE event_type WHEN 'click' THEN 'helpful' WHEN 'error' THEN 'incorrect' ELSE 'other' END AS verdict FROM events)
WHERE verdict <> 'other' GROUP BY 1, 2""")
def a4(w: World) -> DataFrame:
    feedback = w.events.selectExpr("event_id AS feedback_id", "user_id % 5 AS actor", "concat('e', user_id % 11) AS source_key", "concat('d', event_id % 3) AS domain",
        "CASE event_type WHEN 'click' THEN 'helpful' WHEN 'error' THEN 'incorrect' ELSE 'other' END AS verdict", "ts AS created_at")
    return T.feedback_events(feedback).groupBy("source_key", "domain").agg(F.sum("win").alias("wins"), F.sum("loss").alias("losses"))


@query("a5_refit_source_trust", f"WITH {EVENTS_SQL} SELECT source_key, domain, wins::BIGINT AS wins, losses::BIGINT AS losses, round(rate, 9) AS rate FROM trust", "facts")
def a5(w: World) -> DataFrame:
    return T.refit_source_trust(T.trust_events(w.facts)).select("source_key", "domain", "wins", "losses", F.round("rate", 9).alias("rate"))


@query("a6_trust_history", f"""
WITH {EVENTS_SQL} SELECT source_key, domain, round(rate, 9) AS rate FROM trust
WHERE NOT (domain IS NOT NULL AND domain = 'phone') AND (domain IS NULL OR abs(rate - round(rate, 1)) > 0.01)""", "facts")
def a6(w: World) -> DataFrame:
    new = T.refit_source_trust(T.trust_events(w.facts)).where("NOT (domain <=> 'phone')")
    old = new.where("domain IS NOT NULL").withColumn("rate", F.round("rate", 1))
    return T.trust_history(new, old).select("source_key", "domain", F.round("rate", 9).alias("rate"))


@query("j10_trust_lookup", f"""
WITH {EVENTS_SQL}, keys AS (SELECT DISTINCT concat(vertical, ':', recorder) AS source_key, domain FROM facts, (VALUES ('phone'), ('order_status'), ('nothing')) d(domain))
SELECT k.source_key, k.domain, round(coalesce(s.rate, g.rate, 0.5), 9) AS learned FROM keys k
LEFT JOIN trust s ON s.source_key = k.source_key AND s.domain = k.domain AND s.samples >= 8
LEFT JOIN trust g ON g.source_key = k.source_key AND g.domain IS NULL AND g.samples >= 8""", "facts")
def j10(w: World) -> DataFrame:
    trust = T.refit_source_trust(T.trust_events(w.facts))
    keys = w.facts.select(T.source_key(F.col("vertical"), F.col("recorder")).alias("source_key"), F.explode(F.array(*map(F.lit, ("phone", "order_status", "nothing")))).alias("domain")).distinct()
    return T.trust_lookup(keys, trust).withColumn("learned", F.round("learned", 9))


@query("a7_calibration_pairs", f"""
SELECT raw, sum(correct)::BIGINT AS hits, count(*) AS n FROM (SELECT confidence AS raw, CASE WHEN status = 'active' AND retracted_at IS NULL THEN 1 WHEN status IN ('retracted', 'superseded') THEN 0 ELSE 1 END AS correct
 FROM facts WHERE recorded_at < {NOW} - INTERVAL 30 DAY) GROUP BY 1""", "facts")
def a7(w: World) -> DataFrame:
    return T.calibration_pairs(w.facts, _now()).groupBy("raw").agg(F.sum("correct").alias("hits"), F.count(F.lit(1)).alias("n"))


@query("a8_fit_isotonic")
def a8(w: World) -> DataFrame:
    pairs = T.calibration_pairs(w.facts, _now())
    return T.fit_isotonic(pairs).select(F.explode(F.arrays_zip("thresholds", "values")).alias("s"), "samples").select("s.thresholds", F.round("s.values", 9).alias("value"), "samples")


@query("a9_pii_inventory", "SELECT predicate, pii_class, count_if(status = 'active') AS active, count_if(status = 'retracted') AS retracted FROM facts JOIN registry USING (predicate) WHERE pii_class IS NOT NULL GROUP BY 1, 2", "facts registry")
def a9(w: World) -> DataFrame:
    return A.pii_inventory(w.facts, w.registry)


DECISIONS = "CASE event_type WHEN 'error' THEN 'deny' WHEN 'view' THEN 'would_deny' ELSE 'allow' END"


def _decisions(w: World) -> DataFrame:
    return w.events.selectExpr("ts AS at", f"{DECISIONS} AS decision", "concat('act', user_id % 13) AS action", "concat('rule', event_id % 17) AS rule_id")


@query("a10_decision_series", f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count_if(d = 'allow') AS allow, count_if(d = 'deny') AS deny, count_if(d = 'would_deny') AS would_deny FROM (SELECT ts, {DECISIONS} AS d FROM events) GROUP BY 1""")
def a10(w: World) -> DataFrame:
    return A.decision_series(_decisions(w))


@query("a10_decision_top", f"""
WITH d AS (SELECT {DECISIONS} AS d, concat('act', user_id % 13) AS action, concat('rule', event_id % 17) AS rule_id FROM events),
k AS (SELECT 'action' AS kind, action AS value, count(*) AS denials FROM d WHERE d = 'deny' GROUP BY 2 UNION ALL SELECT 'rule', rule_id, count(*) FROM d WHERE d = 'deny' GROUP BY 2)
SELECT kind, value, denials, row_number() OVER (PARTITION BY kind ORDER BY denials DESC, value)::INTEGER AS rank FROM k QUALIFY rank <= 10""")
def a10b(w: World) -> DataFrame:
    return A.decision_top(_decisions(w))


ENDED = f"(valid_until < {CUT} OR retracted_at < {CUT}) AND status <> 'compacted'"


@query("a12_compaction_groups", f"""
SELECT entity_id, predicate, user_id, count(*) AS n, substr(string_agg(object, '; ' ORDER BY valid_from, fact_id), 1, 8000) AS text, round(avg(confidence), 9) AS confidence, CAST(min(valid_from) AS VARCHAR) AS valid_from,
 CAST(max(coalesce(least(valid_until, retracted_at), valid_until, retracted_at)) AS VARCHAR) AS valid_until FROM facts WHERE {ENDED} GROUP BY 1, 2, 3 HAVING count(*) >= 2""", "facts")
def a12(w: World) -> DataFrame:
    g = A.compaction_groups(w.facts, F.expr(CUT))
    return g.select("entity_id", "predicate", "user_id", "n", "text", F.round("confidence", 9).alias("confidence"), F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_until").cast("string").alias("valid_until"))


@query("a12_compact", f"""
SELECT CASE WHEN c >= 2 AND e THEN 'compacted' ELSE status END AS status, count(*) AS n FROM (SELECT status, {ENDED} IS TRUE AS e, count_if({ENDED}) OVER (PARTITION BY entity_id, predicate, user_id) AS c FROM facts) GROUP BY 1""", "facts")
def a12b(w: World) -> DataFrame:
    return A.compact(w.facts, F.expr(CUT)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("a13_promotion_groups", f"""
SELECT entity_id, predicate, count(*) AS n, CAST(min(valid_from) AS VARCHAR) AS first_from, string_agg(DISTINCT object, ',' ORDER BY object) AS objects FROM facts
WHERE status = 'active' AND recorded_at < {NOW} AND predicate = 'summary_profile' GROUP BY 1, 2 HAVING count(*) >= 2""", "facts")
def a13(w: World) -> DataFrame:
    g = A.promotion_groups(w.facts, w.registry, _now(), 2)
    return g.select("entity_id", "predicate", "n", F.col("first_from").cast("string").alias("first_from"), "objects")


@query("a14_aspect_rollups", """
WITH one AS (SELECT *, concat(recorder, ' ', object) AS o FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id, predicate, concat(recorder, ' ', object) ORDER BY valid_from, fact_id) = 1),
used AS (SELECT *, sum(length(o) + 1) OVER (PARTITION BY entity_id, predicate ORDER BY valid_from, fact_id) AS u, count(*) OVER (PARTITION BY entity_id, predicate) AS c FROM one),
eps AS (SELECT entity_id, predicate, string_agg(DISTINCT e, ',' ORDER BY e) AS episodes FROM (SELECT entity_id, predicate, unnest([origin_key, 'e' || n % 7]) AS e FROM used WHERE u <= 40) GROUP BY 1, 2)
SELECT entity_id, predicate, c AS n, count_if(u <= 40) AS shown, coalesce(string_agg(o, chr(10) ORDER BY valid_from, fact_id) FILTER (WHERE u <= 40), '') || CASE WHEN c > count_if(u <= 40) THEN concat(chr(10), '…and ', c - count_if(u <= 40), ' more') ELSE '' END AS text,
 coalesce(any_value(episodes), '') AS episodes
FROM used LEFT JOIN eps USING (entity_id, predicate) WHERE c >= 3 GROUP BY entity_id, predicate, c""", "facts")
def a14(w: World) -> DataFrame:
    rows = w.facts.withColumns({"object": F.concat_ws(" ", "recorder", "object"), "episode_ids": F.array("origin_key", F.expr("concat('e', n % 7)"))})
    return A.aspect_rollups(rows, 40).withColumn("episodes", F.array_join(F.sort_array("episodes"), ","))


@query("a15_densest_entities", "SELECT entity_id, count(*) AS n FROM facts WHERE status = 'active' GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 20", "facts")
def a15(w: World) -> DataFrame:
    return A.densest_entities(w.facts, 20)


@query("a16_contested_slots", "SELECT entity_id, predicate, count(*) AS n, count(DISTINCT object) AS objects FROM facts WHERE status = 'competing' GROUP BY 1, 2", "facts")
def a16(w: World) -> DataFrame:
    return A.contested_slots(w.facts)


@query("a16_evidence_conflicts", r"""
WITH f AS (SELECT entity_id, predicate, status, concat(CASE n % 5 WHEN 0 THEN 'has not ' WHEN 1 THEN 'never ' WHEN 2 THEN 'nevertheless ' ELSE '' END, object) AS object FROM facts),
g AS (SELECT entity_id, predicate, count(*) AS n, count(DISTINCT object) AS objects, count_if(status = 'competing') AS competing,
 count_if(regexp_matches(object, '(?i)\b(?:never|has(?:n''t| not)|have(?:n''t| not)|did(?:n''t| not)|does not|doesn''t)\b')) AS negated FROM f GROUP BY 1, 2)
SELECT * FROM g WHERE objects >= 2 AND (competing > 0 OR (negated > 0 AND negated < n))""", "facts")
def a16_conflicts(w: World) -> DataFrame:
    said = F.concat(F.expr("CASE n % 5 WHEN 0 THEN 'has not ' WHEN 1 THEN 'never ' WHEN 2 THEN 'nevertheless ' ELSE '' END"), "object")
    return A.evidence_conflicts(w.facts.withColumn("object", said))


@query("a17_resolvable_pairs", f"""
SELECT fact_id FROM (SELECT fact_id, count(*) OVER w AS c, max(recorded_at) OVER w AS m FROM facts WHERE status = 'competing' WINDOW w AS (PARTITION BY entity_id, predicate)) WHERE c = 2 AND m < {NOW}""", "facts")
def a17(w: World) -> DataFrame:
    return A.resolvable_pairs(w.facts, _now()).select("fact_id")


@query("a18_self_consistency", """
WITH c AS (SELECT user_id AS batch, event_type AS cluster, count(DISTINCT event_id % 5) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY batch) AS s FROM c)
SELECT batch, cluster, n / 5 AS share, round(sum(-(n / s) * ln(n / s)) OVER (PARTITION BY batch), 9) AS entropy FROM t""")
def a18(w: World) -> DataFrame:
    return A.self_consistency(w.events.selectExpr("user_id AS batch", "event_type AS cluster", "event_id % 5 AS pass"), 5)


@query("a19_conversation_counts", "SELECT conversation_id, count(*) AS n FROM turns GROUP BY 1", "turns")
def a19(w: World) -> DataFrame:
    return A.conversation_counts(w.turns)


@query("a20_cost_breakdown", """
SELECT model, operation, sum(tokens)::BIGINT AS tokens, round(sum(tokens * price), 6) AS cost FROM (SELECT concat('m', user_id % 4) AS model, event_type AS operation, user_id + 10 AS tokens, (user_id % 4) * 0.25::DOUBLE AS price FROM events)
GROUP BY GROUPING SETS ((model), (operation), ())""")
def a20(w: World) -> DataFrame:
    usage = w.events.selectExpr("concat('m', user_id % 4) AS model", "event_type AS operation", "user_id + 10 AS tokens")
    pricing = w.spark.range(4).selectExpr("concat('m', id) AS model", "id * 0.25D AS price")
    return A.cost_breakdown(usage, pricing)


@query("a23_indexer_attribution", "SELECT CASE WHEN event_type = 'error' THEN 'ops' ELSE 'core' END AS pack, count(*) AS n FROM events GROUP BY 1")
def a23(w: World) -> DataFrame:
    return A.indexer_attribution(w.events.selectExpr("CASE WHEN event_type = 'error' THEN concat('ops__', event_type) ELSE event_type END AS predicate"))


@query("a24_conversation_scopes", """
SELECT conversation_id, coalesce(string_agg(DISTINCT user_id, ',' ORDER BY user_id), '') AS users, CASE WHEN count(DISTINCT user_id) = 1 THEN min(user_id) END AS only_user FROM turns GROUP BY 1""", "turns")
def a24(w: World) -> DataFrame:
    return A.conversation_scopes(w.turns)


@query("a25_source_report", f"""
WITH {EVENTS_SQL}, reg AS (SELECT DISTINCT concat(vertical, ':', recorder) AS source_key, CASE vertical WHEN 'billing' THEN 0.95 WHEN 'incidents' THEN 0.9 ELSE 0.5 END::DOUBLE AS declared FROM facts)
SELECT reg.source_key, declared, round(max(CASE WHEN domain IS NULL THEN rate END), 9) AS rate, count(domain) AS domains,
 arg_max(domain, struct_pack(s := samples, d := domain)) FILTER (WHERE domain IS NOT NULL) AS main_domain FROM reg LEFT JOIN trust USING (source_key) GROUP BY ALL""", "facts")
def a25(w: World) -> DataFrame:
    key = T.source_key(F.col("vertical"), F.col("recorder"))
    registry = w.facts.select(key.alias("source_key"), T.declared_trust(F.col("vertical")).alias("declared")).distinct()
    return A.source_report(registry, T.refit_source_trust(T.trust_events(w.facts))).withColumn("rate", F.round("rate", 9))


@query("a25_source_history", f"""
WITH {EVENTS_SQL}, h AS (SELECT source_key, domain, rate, samples, row_number() OVER (PARTITION BY source_key ORDER BY samples DESC, domain) AS n FROM trust)
SELECT source_key, domain, round(rate, 9) AS rate, n FROM h WHERE n <= 2""", "facts")
def a25_history(w: World) -> DataFrame:
    """Scoped and global rates as history rows, of which each source's last two by samples are shown."""
    rows = T.refit_source_trust(T.trust_events(w.facts)).withColumn("recorded_at", F.col("samples"))
    return A.source_history(rows, 2).select("source_key", "domain", F.round("rate", 9).alias("rate"), "n")


@query("a26_rewrite_pattern_counts", "SELECT lower(trim(p_name)) AS pattern, arg_max(p_type, struct_pack(a := p_partkey, b := p_type)) AS replacement, count(*) AS seen FROM part GROUP BY 1")
def a26(w: World) -> DataFrame:
    return A.rewrite_pattern_counts(w.part.selectExpr("concat(' ', upper(p_name)) AS pattern", "p_type AS replacement", "p_partkey AS at"))


@query("a27_change_lag", "SELECT event_type AS source, count(*) AS lag FROM events WHERE event_id > CASE event_type WHEN 'click' THEN 500 WHEN 'view' THEN 100 ELSE -1 END GROUP BY 1")
def a27(w: World) -> DataFrame:
    cursors = w.spark.createDataFrame([("click", 500), ("view", 100)], "source string, cursor long")
    return A.change_lag(w.events.selectExpr("event_type AS source", "event_id AS version"), cursors)


@query("a21_forget_report", """
WITH keys AS (SELECT entity_id FROM entities WHERE n % 50 = 3)
SELECT 'facts' AS kind, entity_id, count(*) AS removed FROM facts WHERE entity_id IN (SELECT entity_id FROM keys) GROUP BY 2
UNION ALL SELECT 'edges', src, count(*) FROM edges WHERE src IN (SELECT entity_id FROM keys) GROUP BY 2""", "facts entities edges")
def a21(w: World) -> DataFrame:
    return A.forget_report({"facts": w.facts, "edges": w.edges.withColumnRenamed("src", "entity_id")}, w.entities.where("n % 50 = 3").select("entity_id"))


SESSIONS = """ses AS (SELECT *, sum(CASE WHEN epoch_us(occurred_at) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY occurred_at, turn_id)::BIGINT AS session
 FROM (SELECT *, lag(occurred_at) OVER (PARTITION BY conversation_id ORDER BY occurred_at, turn_id) AS prev FROM turns))"""


@query("w1_sessionize", f"WITH {SESSIONS} SELECT turn_id, session FROM ses", "turns")
def w1(w: World) -> DataFrame:
    return S.sessionize(w.turns).select("turn_id", "session")


@query("w2_segment_windows", f"""
WITH {SESSIONS}, num AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY occurred_at, turn_id) - 1 AS i, count(*) OVER (PARTITION BY conversation_id) AS c FROM ses),
st AS (SELECT DISTINCT conversation_id, c, unnest(range(0, greatest(0, CAST(ceil((c - 4) / 2) AS BIGINT)) * 2 + 1, 2)) AS start FROM num)
SELECT num.conversation_id, start, string_agg(turn_id, ',' ORDER BY i) AS turns FROM st JOIN num ON st.conversation_id = num.conversation_id AND i >= start AND i < start + 4 GROUP BY 1, 2""", "turns")
def w2(w: World) -> DataFrame:
    return S.segment_windows(w.turns.withColumn("session", F.lit(0))).select("conversation_id", "start", F.array_join("turn_ids", ",").alias("turns"))


@query("w4_best_mention_per_session", "SELECT user_id AS query_id, event_type AS session_key, event_id AS fact_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY round(value) DESC, value DESC, event_id) = 1")
def w4(w: World) -> DataFrame:
    rows = w.events.selectExpr("user_id AS query_id", "event_type AS session_key", "event_id AS fact_id", "floor(value + 0.5) AS lexical", "value AS similarity")
    return S.best_mention_per_session(rows).select("query_id", "session_key", "fact_id")


@query("w7_turn_context", """
WITH num AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY occurred_at, turn_id) AS i FROM turns)
SELECT DISTINCT a.turn_id FROM num a JOIN num b ON a.conversation_id = b.conversation_id AND abs(a.i - b.i) <= 2 WHERE b.n % 40 = 0""", "turns")
def w7(w: World) -> DataFrame:
    return S.turn_context(w.turns, w.turns.where("n % 40 = 0"), 2).select("turn_id")


@query("w8_event_gaps", """
WITH d AS (SELECT DISTINCT entity_id, CAST(valid_from AS DATE) AS day FROM facts)
SELECT entity_id, CAST(day AS VARCHAR) AS day, dayname(day) AS weekday, date_diff('day', lag(day) OVER (PARTITION BY entity_id ORDER BY day), day) AS gap FROM d
QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) <= 12""", "facts")
def w8(w: World) -> DataFrame:
    return S.event_gaps(w.facts.select("entity_id", F.col("valid_from").alias("day")))
