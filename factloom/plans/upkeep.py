"""Queries over texts, maintenance and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import maintenance as M
from factloom.operators import text as X
from factloom.plans.catalog import World, query
from factloom.sources import readers as S

T1, T2 = "TIMESTAMP '1998-01-01 00:00:00'", "TIMESTAMP '1998-04-01 00:00:00'"


@query("x1_redact_pii")
def x1(w: World) -> DataFrame:
    return X.redact_pii(w.documents).select("doc_id", F.sha2("text", 256).alias("sha"), F.array_join("pii_classes", ",").alias("classes"))


@query("x1_pii_report")
def x1b(w: World) -> DataFrame:
    return X.pii_report(X.redact_pii(w.documents))


WORDS = "list_filter(regexp_split_to_array(lower(trim(text)), '[^\\p{L}\\p{M}]+'), lambda t: t <> '')"
HITS = ", ".join(f"len(list_filter(t, lambda x: list_contains([{', '.join(repr(s) for s in stop.split())}], x))) AS h{i}" for i, stop in enumerate(X.STOP_WORDS.values()))
BEST = "CASE greatest(h0, h1, h2, h3, h4, h5) WHEN 0 THEN 'en' " + " ".join(f"WHEN h{i} THEN '{lang}'" for i, lang in enumerate(X.STOP_WORDS)) + " END"


@query("x2_tag_language", f"SELECT doc_id, {BEST} AS language, 'Latn' AS script FROM (SELECT doc_id, {HITS} FROM (SELECT doc_id, {WORDS} AS t FROM documents))")
def x2(w: World) -> DataFrame:
    return X.tag_language(w.documents).select("doc_id", "language", "script")


@query("x2_language_mix", f"SELECT {BEST} AS language, count(*) AS n FROM (SELECT {HITS} FROM (SELECT {WORDS} AS t FROM documents)) GROUP BY 1")
def x2b(w: World) -> DataFrame:
    return X.language_mix(X.tag_language(w.documents))


#: Spans cut out of the texts and of made-up ones: inside words, at their bounds, of a script without blanks, with signs of patterns.
CLAIMS = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('私は東京大学に行く ', text) WHEN 1 THEN concat(text, ' (c++) ÉTÉ') ELSE text END AS text,
 CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN '東京' ELSE '大阪' END WHEN 1 THEN CASE WHEN doc_id % 8 = 1 THEN 'été' ELSE 'ét' END ELSE substr(text, 4, 6) END AS name,
 CASE doc_id % 3 WHEN 0 THEN substr(text, 9, 5) WHEN 1 THEN '(C++)' ELSE '.' END AS value FROM documents"""


@query("x3_check_grounding", f"""
WITH c AS ({CLAIMS}),
k AS (SELECT doc_id, {{0}} AS t, {{1}} AS n, {{2}} AS v FROM c),
r AS (SELECT doc_id, t, n, v, regexp_escape(n) AS qn, regexp_escape(v) AS qv, '[A-Za-zÀ-ɏЀ-ӿ]' AS w, '(^|[^A-Za-zÀ-ɏЀ-ӿ])' AS l, '($|[^A-Za-zÀ-ɏЀ-ӿ])' AS e FROM k),
j AS (SELECT doc_id, n <> '' AND regexp_matches(t, concat(CASE WHEN regexp_matches(n[1], w) THEN l ELSE '' END, qn, CASE WHEN regexp_matches(n[-1], w) THEN e ELSE '' END)) AS a,
 v <> '' AND regexp_matches(t, concat(CASE WHEN regexp_matches(v[1], w) THEN l ELSE '' END, qv, CASE WHEN regexp_matches(v[-1], w) THEN e ELSE '' END)) AS b FROM r)
SELECT doc_id AS claim_id, CASE WHEN NOT coalesce(a, false) THEN 'ungrounded_entity' WHEN NOT coalesce(b, false) THEN 'ungrounded_value' END AS reason FROM j""".format(
    *(f"lower(trim(regexp_replace({c}, '[\\s\\pZ\\x{{FEFF}}]+', ' ', 'g')))" for c in ("text", "name", "value"))))
def x3(w: World) -> DataFrame:
    made = w.spark.sql(CLAIMS.replace("FROM documents", "FROM {documents}"), documents=w.documents)
    return X.check_grounding(made.selectExpr("doc_id AS claim_id", "doc_id", "name", "value"), made).select("claim_id", "reason")


@query("x4_chunk_documents")
def x4(w: World) -> DataFrame:
    return X.chunk_documents(w.documents, 1200, 1600, 40).select("doc_id", "seq", "char_start", "char_end", F.sha2("text", 256).alias("sha"))


PACKS = [
    {"name": "all", "always": True}, {"name": "three", "verticals": ["src3"]},
    {"name": "legal", "keywords": ["license", "licensed"], "vector": [1] * 32 + [-1] * 32}, {"name": "near", "vector": [1, -1] * 32},
]
NEAR = "list_cosine_similarity(e.embedding::DOUBLE[], {}::DOUBLE[]) >= 0.1"


@query("x5_route_documents", f"""
WITH d AS (SELECT d.*, {NEAR.format([1] * 32 + [-1] * 32)} AS n1, {NEAR.format([1, -1] * 32)} AS n2, regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])(license|licensed)($|[^\\p{{L}}\\p{{N}}])') AS k
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT doc_id, 'all' AS pack, 'always' AS rule FROM d UNION ALL SELECT doc_id, 'three', 'vertical' FROM d WHERE source = 'src3'
UNION ALL SELECT doc_id, 'legal', CASE WHEN k THEN 'keyword' ELSE 'embedding' END FROM d WHERE k OR n1 UNION ALL SELECT doc_id, 'near', 'embedding' FROM d WHERE n2""")
def x5(w: World) -> DataFrame:
    docs = w.documents.join(w.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return X.route_documents(docs, PACKS, 0.1)


@query("x6_extract_periods", """
SELECT event_id, CAST(CASE k WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) ELSE date_trunc('year', d) END AS DATE)::VARCHAR AS period_from,
 CAST(CASE k WHEN 0 THEN d + INTERVAL 1 DAY WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH ELSE date_trunc('year', d) + INTERVAL 1 YEAR END AS DATE)::VARCHAR AS period_to
FROM (SELECT event_id, event_id % 3 AS k, CAST(ts AS DATE) AS d FROM events)""")
def x6(w: World) -> DataFrame:
    said = w.events.selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN concat('it was on ', date_format(ts, 'd MMMM yyyy'), ' in 2011') WHEN 1 THEN concat('in ', date_format(ts, 'MMMM yyyy'), ' or so') ELSE concat('some time in ', year(ts)) END AS text")
    return X.extract_periods(said).select("event_id", F.col("period_from").cast("string").alias("period_from"), F.col("period_to").cast("string").alias("period_to"))


#: Commits made of the documents: subjects of all kinds, bodies that are empty, short, long, with trailers and with markers.
COMMITS = """
SELECT doc_id, concat(CASE doc_id % 9 WHEN 0 THEN 'Merge branch x' WHEN 1 THEN 'chore: tidy' WHEN 2 THEN 'docs(api): words' WHEN 3 THEN 'feat!: more' WHEN 4 THEN 'fix(core): less'
 WHEN 5 THEN 'Merge of two lists' WHEN 6 THEN 'use a map instead of a list' WHEN 7 THEN 'Docs: words' ELSE 'tidy up' END, ' ') AS subject,
 CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN text WHEN 2 THEN concat('  ', substr(text, 1, 60), '  ') WHEN 3 THEN concat('Words\n  Why: ', substr(text, 1, 9)) WHEN 4 THEN 'Done IN ORDER TO help'
 WHEN 5 THEN concat('Gotcha: \n', substr(text, 1, 20)) END AS body, CASE WHEN doc_id % 5 = 0 THEN 'we did it to avoid harm' END AS pr_body FROM documents"""


@query("x7_classify_commits", rf"""
WITH c AS ({COMMITS.replace("'Words\n  Why: '", "'Words' || chr(10) || '  Why: '").replace("'Gotcha: \n'", "'Gotcha: ' || chr(10)")}),
p AS (SELECT doc_id, trim(subject) AS s, regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g') AS b, lower(coalesce(body, '') || chr(10) || coalesce(pr_body, '')) AS h FROM c),
k AS (SELECT *, regexp_extract(s, '^([a-z]+)(?:\([^)]*\))?!?:', 1) AS t, length(b) >= 80 AS long,
 len(list_filter(['because', 'so that', 'in order to', 'instead of', 'rather than', 'to avoid', 'to prevent', 'otherwise', 'the reason'], lambda m: contains(h, m))) > 0 AS why,
 len(list_filter(list_transform(string_split(b, chr(10)), lambda x: lower(regexp_extract(trim(x), '^([A-Za-z][A-Za-z -]*):\s+.+$', 1))),
  lambda key: key IN ('decision', 'why', 'rationale', 'breaking change', 'breaking-change', 'gotcha', 'invariant'))) > 0 AS trailer FROM p),
r AS (SELECT doc_id, CASE WHEN regexp_matches(s, '^Merge (branch|pull request|remote-tracking) ') THEN 'merge' WHEN trailer THEN 'trailer'
 WHEN t IN ('chore', 'style', 'ci', 'build', 'test', 'docs') AND NOT long AND NOT why THEN 'routine' WHEN why THEN 'rationale'
 WHEN t IN ('feat', 'fix', 'refactor', 'perf', 'revert') AND long THEN 'typed_body' WHEN long THEN 'body' ELSE 'short' END AS rule FROM k)
SELECT doc_id, rule, rule IN ('trailer', 'rationale', 'typed_body', 'body') AS decision FROM r""")
def x7(w: World) -> DataFrame:
    commits = w.spark.sql(COMMITS.replace("FROM documents", "FROM {documents}"), documents=w.documents)
    return X.classify_commits(commits).select("doc_id", "rule", "decision")


@query("x8_train_gate")
def x8(w: World) -> DataFrame:
    """A gate learnt from labelled documents, a fifth of which is held out, scores all documents."""
    rows = X.gate_vectors(X.gate_features(w.documents.select("doc_id", "text"), "text").drop("text"), X.SHAPE)
    labelled = rows.join(w.labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = X.gate_score(X.train_gate(labelled.where(~held_out)), rows)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).alias("passed"))


@query("u4_dedupe_mentions")
def u4(w: World) -> DataFrame:
    lines = w.conversations.selectExpr("conv_id AS query_id", "turn AS seq", "concat('[day] ', role, ': ', text) AS text")
    return X.dedupe_mentions(lines).select("query_id", "seq")


@query("h16_folded_texts", "SELECT doc_id, sha256(strip_accents(lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))))) AS sha FROM documents")
def h16(w: World) -> DataFrame:
    return w.documents.select("doc_id", F.sha2(X.fold_object("text"), 256).alias("sha"))


@query("h19_prefix_table", """
WITH n AS (SELECT p_partkey AS e, p_name AS name, p_size AS weight FROM part), p AS (SELECT e, name, weight, unnest(range(2, least(15, length(name)) + 1)) AS k FROM n)
SELECT lower(name)[1:k] AS prefix, row_number() OVER (PARTITION BY lower(name)[1:k] ORDER BY weight DESC, name, e)::INTEGER AS rank, e AS entity_id FROM p QUALIFY rank <= 10""")
def h19(w: World) -> DataFrame:
    return X.prefix_table(w.part.selectExpr("p_partkey AS entity_id", "p_name AS name", "p_size AS weight")).select("prefix", "rank", "entity_id")


@query("u1_memory_diff", f"""
WITH fresh AS (SELECT * FROM facts WHERE recorded_at >= {T1} AND recorded_at < {T2})
SELECT 'changed' AS section, o.fact_id AS id, fresh.fact_id AS replaced_by, o.object AS before, fresh.object AS after FROM fresh JOIN facts o ON o.superseded_by = fresh.fact_id
UNION ALL SELECT 'created', fact_id, NULL, NULL, NULL FROM fresh WHERE fact_id NOT IN (SELECT superseded_by FROM facts WHERE superseded_by IS NOT NULL)
UNION ALL SELECT 'retracted', fact_id, NULL, NULL, NULL FROM facts WHERE retracted_at >= {T1} AND retracted_at < {T2}
UNION ALL SELECT 'forgotten', sha256(entity_id), NULL, NULL, NULL FROM facts WHERE n % 300 = 5 AND recorded_at >= {T1} AND recorded_at < {T2}
UNION ALL SELECT 'new_entity', entity_id, NULL, NULL, NULL FROM facts GROUP BY entity_id HAVING min(valid_from) >= {T1} AND min(valid_from) < {T2}""", "facts")
def u1(w: World) -> DataFrame:
    """Tombstones stand for a few entities, as of the day that one of their facts was recorded."""
    entities = w.facts.groupBy("entity_id").agg(F.min("valid_from").alias("created_at"))
    stones = w.facts.where("n % 300 = 5").select(F.sha2("entity_id", 256).alias("hash"), F.col("recorded_at").alias("forgotten_at"))
    return M.memory_diff(w.facts, entities, F.expr(T1), F.expr(T2), stones)


@query("u3_forget_entities", """
WITH k AS (SELECT entity_id FROM entities WHERE n % 50 = 3)
SELECT 'facts' AS kind, count(*) AS n FROM facts WHERE entity_id NOT IN (SELECT entity_id FROM k) UNION ALL SELECT 'edges', count(*) FROM edges WHERE src NOT IN (SELECT entity_id FROM k) AND dst NOT IN (SELECT entity_id FROM k)
UNION ALL SELECT 'tombstones', count(*) FROM k""", "facts entities edges")
def u3(w: World) -> DataFrame:
    kept, stones = M.forget_entities({"facts": (w.facts, ["entity_id"]), "edges": (w.edges, ["src", "dst"])}, w.entities.where("n % 50 = 3").select("entity_id"), "secret")
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(kept["facts"], "facts").union(count(kept["edges"], "edges")).union(count(stones, "tombstones"))


@query("u3_forget_users", """
WITH touched AS (SELECT DISTINCT entity_id FROM facts WHERE user_id = 'u3')
SELECT 'facts' AS kind, count(*) AS n FROM facts WHERE user_id IS DISTINCT FROM 'u3' UNION ALL SELECT 'edges', count(*) FROM edges WHERE user_id IS DISTINCT FROM 'u3'
UNION ALL SELECT 'usage', count(*) FROM links WHERE fact_id NOT IN (SELECT fact_id FROM facts WHERE user_id = 'u3') UNION ALL SELECT 'artifacts', count(*) FROM entities WHERE entity_id NOT IN (SELECT entity_id FROM touched)
UNION ALL SELECT 'tombstone facts', count(*) FROM facts WHERE user_id = 'u3'""", "facts entities edges links")
def u3b(w: World) -> DataFrame:
    tables = {"facts": (w.facts, {"user": "user_id"}), "edges": (w.edges, {"user": "user_id"}), "usage": (w.links, {"fact": "fact_id"}), "artifacts": (w.entities, {"entity": "entity_id"})}
    kept, stones = M.forget_users(tables, w.spark.createDataFrame([("u3",)], "user_id string"), "secret")
    out = stones.agg(F.sum("facts").alias("n")).select(F.lit("tombstone facts").alias("kind"), "n")
    for name, df in kept.items():
        out = out.union(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n"))
    return out


@query("u5_world_union", "SELECT fact_id, derived_version FROM facts WHERE derived_version IN ('v0', 'v1')", "facts")
def u5(w: World) -> DataFrame:
    return M.world_union(w.facts, ["v0", "v1"]).select("fact_id", "derived_version")


@query("snk4_upsert_usage", """
SELECT user_id AS fact_id, count(*) AS read_count, epoch_us(max(ts)) AS last_read_at FROM events GROUP BY 1""")
def snk4(w: World) -> DataFrame:
    read = lambda cond: w.events.where(cond).selectExpr("user_id AS fact_id", "ts AS at")
    none = w.events.limit(0).selectExpr("user_id AS fact_id", "0L AS read_count", "ts AS last_read_at")
    first = M.upsert_usage(none, read("event_id % 2 = 0"))
    return M.upsert_usage(first, read("event_id % 2 = 1")).select("fact_id", "read_count", F.unix_micros(F.col("last_read_at").cast("timestamp")).alias("last_read_at"))


@query("snk5_sweep_candidates", f"""
SELECT CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 7 DAY THEN 'expired' WHEN event_type = 'view' THEN 'pending' ELSE event_type END AS status, count(*) AS n FROM events
WHERE NOT (event_type <> 'view' AND ts < TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 20 DAY - INTERVAL 10 DAY) GROUP BY 1""")
def snk5(w: World) -> DataFrame:
    rows = w.events.selectExpr("CASE event_type WHEN 'view' THEN 'pending' ELSE event_type END AS status", "ts AS created_at")
    return M.sweep_candidates(rows, F.expr("TIMESTAMP '2024-01-28 00:00:00'")).groupBy("status").agg(F.count("*").alias("n"))


@query("snk5_sweep_documents", "SELECT fact_id FROM facts WHERE origin_key IN (SELECT concat('doc:', doc_id) FROM documents WHERE n_chars < 900)", "facts")
def snk5b(w: World) -> DataFrame:
    docs = w.documents.selectExpr("CAST(doc_id AS STRING) AS hash", "CASE WHEN n_chars < 900 THEN TIMESTAMP '1998-01-01' END AS retain_until")
    return M.sweep_documents(docs, w.facts, F.expr(T2))[1].where("source_purged").select("fact_id")


@query("snk6_gc_worlds", "SELECT derived_version, count(*) AS n FROM facts WHERE derived_version IS NOT NULL AND derived_version <> 'v1' GROUP BY 1", "facts")
def snk6(w: World) -> DataFrame:
    return M.gc_worlds(w.facts, w.spark.createDataFrame([("v1",)], "version string"))[1]


@query("src2_ingest_documents")
def src2(w: World) -> DataFrame:
    return S.ingest_documents(w.documents).select("doc_id", "hash", "deduplicated")


@query("src6_episodes_since", "SELECT turn_id FROM turns WHERE occurred_at > TIMESTAMP '2024-01-05 00:00:00' ORDER BY occurred_at, turn_id LIMIT 200", "turns")
def src6(w: World) -> DataFrame:
    return S.episodes_since(w.turns.withColumn("recorded_at", F.col("occurred_at")), F.expr("TIMESTAMP '2024-01-05 00:00:00'")).select("turn_id")


@query("src5_normalize_changes", """
SELECT CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'UPDATE' ELSE 'CREATE' END AS op, concat('e', event_id) AS record_id FROM events""")
def src5(w: World) -> DataFrame:
    item = "concat('{\"id\":\"e', event_id, '\"}')"
    changes = w.events.selectExpr("event_id AS version", f"CASE WHEN event_type NOT IN ('error', 'view') THEN {item} END AS `create`", f"CASE WHEN event_type = 'view' THEN {item} END AS `update`",
        "CAST(NULL AS STRING) AS current", f"CASE WHEN event_type = 'error' THEN {item} END AS `delete`")
    return S.normalize_changes(changes).select("op", "record_id")
