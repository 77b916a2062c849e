"""Queries over similarity, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.vectors import cosine
from factloom.operators import evaluation as E
from factloom.operators import inverted
from factloom.operators import lexical as X
from factloom.operators import retrieval as R
from factloom.operators import similarity as S
from factloom.operators.neighbours import within
from factloom.plans.catalog import NOW, World, query

PAST = "TIMESTAMP '1998-03-01 00:00:00'"


def _vectors(w: World) -> DataFrame:
    return w.embeddings.select(F.col("vec_id").alias("fact_id"), "embedding")


def _queries(w: World) -> DataFrame:
    return w.embeddings.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("h14_cosine", f"SELECT a.vec_id, round({COS}, 9) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h14(w: World) -> DataFrame:
    b = w.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return w.embeddings.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("e")), 9).alias("c"))


@query("k1_exact_knn", f"""
SELECT a.vec_id AS query_id, b.vec_id AS fact_id, round({COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id)::INTEGER AS rank
FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0 QUALIFY rank <= 10""")
def k1(w: World) -> DataFrame:
    return S.exact_knn(_queries(w), _vectors(w), 10).withColumn("similarity", F.round("similarity", 6))


@query("k2_approx_knn")
def k2(w: World) -> DataFrame:
    return inverted.approx_knn(_queries(w), _vectors(w), 10)


@query("k13_nearest_rules", f"""
SELECT a.vec_id AS query_id, b.vec_id AS fact_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.label, b.vec_id)::INTEGER AS place
FROM embeddings a, embeddings b WHERE a.vec_id % 25 = 0 AND {COS} >= 0.4 QUALIFY place <= 5""")
def k13(w: World) -> DataFrame:
    """Rules (vectors with a priority, here the label) whose trigger is near enough."""
    near = within(_queries(w), _vectors(w), 0.4, 1.0, 5)
    rules = near.join(w.embeddings.select(F.col("vec_id").alias("fact_id"), F.col("label").alias("priority")), "fact_id")
    ranked = X.top_k_per_query(rules.withColumn("s", F.struct("similarity", (-F.col("priority")).alias("p"))), "s", 5)
    return ranked.select("query_id", "fact_id", F.col("rank").alias("place"))


@query("k14_search_communities", f"""
WITH c AS (SELECT label, list(x ORDER BY i) AS embedding FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT a.vec_id AS query_id, b.label AS fact_id FROM embeddings a, c b WHERE a.vec_id % 25 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.label) <= 2""")
def k14(w: World) -> DataFrame:
    mean = w.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = mean.groupBy(F.col("label").alias("fact_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    return S.exact_knn(_queries(w), centres, 2).select("query_id", "fact_id")


@query("j6_competing_pairs", f"""
SELECT a.vec_id AS fact_id, b.vec_id AS fact_id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 3 = b.vec_id % 3 AND a.vec_id < b.vec_id
WHERE a.vec_id < b.vec_id % 100 + 200 AND b.vec_id < a.vec_id % 100 + 200 AND {COS} >= 0.3""")
def j6(w: World) -> DataFrame:
    facts = w.embeddings.selectExpr("vec_id AS fact_id", "label AS entity_id", "vec_id % 3 AS predicate", "embedding", "vec_id AS valid_from", "vec_id % 100 + 200 AS valid_until")
    return S.same_group_pairs(facts, ["entity_id", "predicate"], 0.3).select("fact_id", "fact_id_b")


@query("j7_corroboration_pairs", f"""
WITH g AS (SELECT *, vec_id % 80 AS p, count(*) OVER (PARTITION BY label, vec_id % 80) AS c FROM embeddings)
SELECT b.vec_id AS younger, a.vec_id AS elder FROM g a JOIN g b ON a.label = b.label AND a.p = b.p AND a.vec_id < b.vec_id AND a.vec_id % 7 <> b.vec_id % 7
WHERE a.c BETWEEN 2 AND 8 AND {COS} >= 0.1 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) = 1""")
def j7(w: World) -> DataFrame:
    facts = w.embeddings.selectExpr("vec_id AS fact_id", "label AS entity_id", "vec_id % 80 AS predicate", "embedding", "'active' AS status", "vec_id % 7 AS origin_key",
        "vec_id AS recorded_at", "0 AS valid_from", "CAST(NULL AS INT) AS valid_until")
    return S.corroboration_pairs(facts, 0.1).select("younger", "elder")


@query("j8_near_duplicate_entities", f"""
WITH top AS (SELECT a.vec_id AS q, b.vec_id AS f, {COS} AS s FROM embeddings a, embeddings b WHERE {COS} >= 0.5 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 6)
SELECT least(q, f) AS a, greatest(q, f) AS b FROM top WHERE q <> f AND least(q, f) % 10 <> 0 GROUP BY 1, 2""")
def j8(w: World) -> DataFrame:
    names = w.embeddings.select(F.col("vec_id").alias("entity_id"), "embedding")
    linked = S.near_duplicate_entities(names, w.spark.createDataFrame([], "a long, b long"), 0.5).where("a % 10 = 0")
    return S.near_duplicate_entities(names, linked, 0.5).select("a", "b")


TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
BM25 = f"""
ask AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark WHERE item_id % 10 = 0),
doc AS (SELECT doc_id, len({TOK}) AS length, unnest({TOK}) AS term FROM documents),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM doc GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS docs, avg(len({TOK})) AS mean FROM documents),
wt AS (SELECT query_id, doc_id, term, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) AS weight FROM ask JOIN tf USING (term) JOIN df USING (term), st)"""


def _bm25_queries(w: World) -> DataFrame:
    return w.benchmark.where("item_id % 10 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("k3_bm25", f"""WITH {BM25} SELECT query_id, doc_id, round(sum(weight), 6) AS bm25 FROM wt GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 9) DESC, doc_id) <= 10""")
def k3(w: World) -> DataFrame:
    return X.bm25(_bm25_queries(w), w.documents, 10).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@query("k3_bm25_stemmed")
def k3_stemmed(w: World) -> DataFrame:
    """Every item; terms without accents and English suffixes on both sides."""
    items = w.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return X.bm25(items, w.documents, 10, analysis=X.stemmed).select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


@query("h18_stemmed_terms")
def h18(w: World) -> DataFrame:
    """How many words of the documents fall together under each stem, over distinct words."""
    each = w.documents.select(F.explode(X.words(F.col("text"))).alias("word")).distinct()
    return each.select("word", X.english_terms(F.array("word"))[0].alias("stem")).groupBy("stem").agg(F.count("*").alias("words"), F.min("word").alias("first"))


#: Topics of items, and such of which no term is left: those are phrases.
TOPICS = """
SELECT item_id AS query_id, CASE item_id % 10 WHEN 0 THEN text WHEN 5 THEN CASE item_id % 3 WHEN 0 THEN 'to be' WHEN 1 THEN 'of the' ELSE 'In the, of' END END AS text FROM benchmark WHERE item_id % 5 = 0"""
STOPPED = "'the', 'and', 'for', 'with', 'that', 'this', 'about', 'into', 'from', 'over', 'have', 'has', 'had', 'was', 'were', 'are', 'you', 'your', 'our', 'mention', 'only', 'item', 'items', 'order', 'answer'"


@query("k19_bm25_any_term", f"""
WITH topic AS ({TOPICS}),
split AS (SELECT query_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9а-яё]+'), lambda t: length(t) >= 3 AND t NOT IN ({STOPPED})) AS t FROM topic),
firsts AS (SELECT query_id, text, list_filter(t, lambda x, i: list_position(t, x) = i)[1:8] AS t FROM split),
ask AS (SELECT query_id, unnest(t) AS term FROM firsts),
said AS (SELECT query_id, {TOK} AS p FROM firsts WHERE len(t) = 0),
toks AS (SELECT doc_id, {TOK} AS w FROM documents), doc AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM toks),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM doc GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM toks),
wt AS (SELECT doc_id, term, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) AS weight FROM tf JOIN df USING (term), st),
phrase AS (SELECT query_id, doc_id, unnest(list_distinct(p)) AS term FROM said JOIN toks ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
met AS (SELECT query_id, doc_id, weight FROM ask JOIN wt USING (term) UNION ALL SELECT query_id, doc_id, weight FROM phrase JOIN wt USING (doc_id, term))
SELECT query_id, doc_id, round(sum(weight), 6) AS bm25 FROM met GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 9) DESC, doc_id) <= 10""")
def k19(w: World) -> DataFrame:
    topics = w.spark.sql(TOPICS.replace("FROM benchmark", "FROM {benchmark}"), benchmark=w.benchmark)
    return X.bm25_any_term(topics, w.documents, ["text"], 10, 8, "doc_id").select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"))


def _legs(w: World) -> tuple[DataFrame, DataFrame]:
    """Stand-ins for the two legs: facts asked for by their entity, with made similarities and lexical scores."""
    rows = w.facts.withColumn("query_id", F.col("entity_id"))
    vector = rows.where("n % 3 <> 0").select("query_id", "fact_id", F.expr("CAST(n % 97 AS DOUBLE) / 80 - 0.1D").alias("similarity"))
    lexical = rows.where("n % 4 <> 0").select("query_id", "fact_id", F.expr("CAST(n % 89 AS DOUBLE) / 10").alias("bm25"))
    return vector, lexical


LEGS = """
fused AS (SELECT fact_id, entity_id AS query_id, entity_id, predicate, object, recorder, confidence, recorded_at, valid_from, valid_until, n,
 0.5::DOUBLE * CASE WHEN n % 3 = 0 THEN 0 ELSE greatest(0, least(1, (n % 97)::DOUBLE / 80 - 0.1::DOUBLE)) END + 0.5::DOUBLE * CASE WHEN n % 4 = 0 THEN 0 ELSE ((n % 89)::DOUBLE / 10) / (1 + (n % 89)::DOUBLE / 10) END AS fused,
 concat_ws(',', CASE WHEN n % 3 <> 0 THEN 'vector' END, CASE WHEN n % 4 <> 0 THEN 'lexical' END) AS stages FROM facts WHERE n % 12 <> 0),
scored AS (SELECT f.*, fused * CASE WHEN half_life_days IS NULL THEN 1 ELSE exp(-0.6931471805599453 * (epoch_us(TIMESTAMP '1999-06-01 00:00:00') - epoch_us(recorded_at)) / 86400000000.0::DOUBLE / half_life_days) END * confidence AS score FROM fused f LEFT JOIN registry USING (predicate))"""


@query("k4_fuse", f"WITH {LEGS} SELECT query_id, fact_id, round(fused, 9) AS fused, stages FROM fused", "facts registry")
def k4(w: World) -> DataFrame:
    return R.fuse(*_legs(w)).withColumn("fused", F.round("fused", 9))


def _scored(w: World) -> DataFrame:
    return R.score_facts(R.fuse(*_legs(w)).join(w.facts, "fact_id"), w.registry, F.expr(NOW)).withColumn("object", F.concat_ws(" ", "recorder", "object"))


#: Scores of round factors often lie just between two roundings, so they are cut at an odd place instead.
K5_SQL = f"""
WITH {LEGS},
marked AS (SELECT f.*, (n % 6) / 5.0::DOUBLE AS learned, CASE WHEN n % 8 <> 0 THEN 0.25::DOUBLE + (n % 3) * 0.25::DOUBLE END AS declared, n % 5 AS corroborations,
  (n % 4) / 4.0::DOUBLE AS authority, n % 7 AS salience, CASE WHEN predicate = 'phone' THEN 'said' END AS alias, epoch_us(valid_from) AS f_, epoch_us(valid_until) AS u_,
  epoch_us({PAST}) AS m_, epoch_us(TIMESTAMP '1998-01-01 00:00:00') AS b_, epoch_us(TIMESTAMP '1998-04-01 00:00:00') AS e_ FROM fused f)
SELECT query_id, fact_id, floor(1e8::DOUBLE * (fused
  * CASE WHEN half_life_days IS NULL THEN 1 ELSE exp(-0.6931471805599453 * (epoch_us({NOW}) - epoch_us(recorded_at)) / 86400000000.0::DOUBLE / half_life_days) END
  * CASE WHEN confidence <= 0.5 THEN 0.4123::DOUBLE WHEN confidence <= 0.8 THEN 0.7071::DOUBLE ELSE 0.9013::DOUBLE END
  * CASE WHEN coalesce(alias, m.predicate) = 'said' THEN 0.3::DOUBLE ELSE 1 END
  * (1 + 0.5::DOUBLE * (coalesce(CASE WHEN learned <> 0.5 THEN learned END, declared, 0.5::DOUBLE) - 0.5::DOUBLE))
  * (1 + 0.1::DOUBLE * least(corroborations, 3)) * (1 + 0.2::DOUBLE * authority)
  * CASE WHEN f_ <= m_ AND (u_ IS NULL OR u_ > m_) THEN 1 ELSE 0.25::DOUBLE + 0.75::DOUBLE * exp(-0.6931471805599453 * (CASE WHEN f_ > m_ THEN f_ - m_ ELSE m_ - u_ END) / 86400000000.0::DOUBLE / 90) END
  * CASE WHEN (u_ IS NOT NULL AND f_ < e_ AND b_ < u_) OR (u_ IS NULL AND f_ >= b_ AND f_ < e_) THEN 1
    ELSE 0.25::DOUBLE + 0.75::DOUBLE * exp(-0.6931471805599453 * greatest(0, (CASE WHEN f_ >= e_ THEN f_ - e_ ELSE b_ - coalesce(u_, f_) END) / 86400000000.0::DOUBLE) / 90) END
  * CASE salience WHEN 0 THEN 0.8::DOUBLE WHEN 2 THEN 1.1::DOUBLE WHEN 3 THEN 1.25::DOUBLE ELSE 1 END) + 0.3141593::DOUBLE) / 1e8::DOUBLE AS score
FROM marked m LEFT JOIN registry r ON r.predicate = coalesce(alias, m.predicate)"""


@query("k5_score_facts", K5_SQL, "facts registry")
def k5(w: World) -> DataFrame:
    """All ten factors at once, with made trust, corroborations, authority, salience and aliases; `said` has no half-life."""
    rows = R.fuse(*_legs(w)).join(w.facts, "fact_id").selectExpr(
        "*", "(n % 6) / 5.0D AS learned_trust", "CASE WHEN n % 8 <> 0 THEN 0.25D + (n % 3) * 0.25D END AS declared_trust", "n % 5 AS corroboration_count",
        "(n % 4) / 4.0D AS authority", "n % 7 AS salience", "CASE WHEN predicate = 'phone' THEN 'said' END AS predicate_alias",
    )
    steps = w.spark.sql("SELECT array(0.5D, 0.8D, 1.0D) AS thresholds, array(0.4123D, 0.7071D, 0.9013D) AS values")
    period = (F.expr("TIMESTAMP '1998-01-01 00:00:00'"), F.expr("TIMESTAMP '1998-04-01 00:00:00'"))
    scored = R.score_facts(rows, w.registry, F.expr(NOW), F.expr(PAST), period, steps, 0.3, 0.5, 0.1, 0.2, True)
    return scored.select("query_id", "fact_id", (F.floor(1e8 * F.col("score") + 0.3141593) / 1e8).alias("score"))


GAP = "(CASE WHEN valid_from > {p} THEN epoch_us(valid_from) - epoch_us({p}) ELSE epoch_us({p}) - epoch_us(valid_until) END) / 86400000000.0::DOUBLE".format(p=PAST)


@query("h11_overlap_factor", f"""
SELECT fact_id, round(CASE WHEN valid_from <= {PAST} AND (valid_until IS NULL OR valid_until > {PAST}) THEN 1 ELSE 0.25 + 0.75 * exp(-0.6931471805599453 * {GAP} / 90) END, 9) AS f FROM facts""", "facts")
def h11(w: World) -> DataFrame:
    return w.facts.select("fact_id", F.round(R.overlap_factor(F.expr(PAST)), 9).alias("f"))


@query("h10_period_factor", """
WITH p AS (SELECT *, epoch_us(TIMESTAMP '1998-01-01 00:00:00') AS b, epoch_us(TIMESTAMP '1998-04-01 00:00:00') AS e, epoch_us(valid_from) AS f, epoch_us(valid_until) AS u FROM facts)
SELECT fact_id, round(CASE WHEN (u IS NOT NULL AND f < e AND b < u) OR (u IS NULL AND f >= b AND f < e) THEN 1
 ELSE 0.25 + 0.75 * exp(-0.6931471805599453 * greatest(0, (CASE WHEN f >= e THEN f - e ELSE b - coalesce(u, f) END) / 86400000000.0::DOUBLE) / 90) END, 9) AS f FROM p""", "facts")
def h10(w: World) -> DataFrame:
    begin, stop = F.expr("TIMESTAMP '1998-01-01 00:00:00'"), F.expr("TIMESTAMP '1998-04-01 00:00:00'")
    return w.facts.select("fact_id", F.round(R.period_factor(begin, stop), 9).alias("f"))


@query("h12_diversity_key", """
SELECT DISTINCT p_partkey, concat_ws('|', p_brand, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda t: length(t) >= 3)[1:3]), ' ')) AS k FROM part""")
def h12(w: World) -> DataFrame:
    return w.part.select("p_partkey", R.diversity_key(F.col("p_brand"), F.col("p_name")).alias("k"))


BUCKETS = f"""{LEGS},
keyed AS (SELECT query_id, entity_id, concat(predicate, '|', array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(concat(recorder, ' ', object)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: length(t) >= 3)[1:3]), ' ')) AS k, max(score) AS s FROM scored GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY s DESC, k) AS r FROM keyed),
bk AS (SELECT query_id, entity_id, max(s) AS best, max(s) + 0.3 * coalesce(sum(CASE WHEN r > 1 THEN s END), 0) AS rank_score FROM rk WHERE r <= 3 GROUP BY 1, 2)"""


@query("k6_bucket_entities", f"WITH {BUCKETS} SELECT query_id, entity_id, round(best, 9) AS best, round(rank_score, 9) AS rank_score FROM bk", "facts registry")
def k6(w: World) -> DataFrame:
    return R.bucket_entities(_scored(w)).select("query_id", "entity_id", F.round("best", 9).alias("best"), F.round("rank_score", 9).alias("rank_score"))


@query("k8_assemble_hits", f"""
WITH {BUCKETS}, nth AS (SELECT s.*, row_number() OVER (PARTITION BY query_id, entity_id ORDER BY score DESC, fact_id) AS i FROM scored s)
SELECT bk.query_id, 1 AS entity_rank, bk.entity_id, round(rank_score, 9) AS rank_score, string_agg(fact_id, ',' ORDER BY i) AS facts,
 arg_min(fact_id, i) AS best, arg_min(CASE WHEN CAST(substr(fact_id, 2) AS INTEGER) % 3 = 0 THEN fact_id END, i) FILTER (WHERE CAST(substr(fact_id, 2) AS INTEGER) % 3 = 0) AS third
FROM bk JOIN nth ON bk.query_id = nth.query_id AND i <= 5 GROUP BY ALL""", "facts registry")
def k8(w: World) -> DataFrame:
    """Each fact brings a reference of its own, every third one of another kind."""
    scored = _scored(w)
    third = F.when(F.substring("fact_id", 2, 99).cast("int") % 3 == 0, F.create_map(F.lit("best"), "fact_id", F.lit("third"), "fact_id")).otherwise(F.create_map(F.lit("best"), "fact_id"))
    hits = R.assemble_hits(scored.withColumn("refs", third), R.bucket_entities(scored), 3)
    refs = F.col("refs")
    return hits.select("query_id", "entity_rank", "entity_id", F.round("rank_score", 9).alias("rank_score"), F.array_join("facts", ",").alias("facts"), refs["best"].alias("best"), F.element_at("refs", "third").alias("third"))


@query("k18_rrf_fuse", """
WITH r AS (SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fact_id) AS r FROM (SELECT entity_id AS query_id, fact_id, (n % 97)::DOUBLE / 80 - 0.1 AS s FROM facts WHERE n % 3 <> 0)
 UNION ALL SELECT query_id, fact_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fact_id) FROM (SELECT entity_id AS query_id, fact_id, n % 89 AS s FROM facts WHERE n % 4 <> 0))
SELECT query_id, fact_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM r GROUP BY 1, 2""", "facts")
def k18(w: World) -> DataFrame:
    vector, lexical = _legs(w)
    lists = [X.top_k_per_query(vector, "similarity", 1 << 30), X.top_k_per_query(lexical, "bm25", 1 << 30)]
    return R.rrf_fuse(lists).withColumn("rrf", F.round("rrf", 9))


@query("k9_rescore_window", f"""
WITH {LEGS}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fact_id) AS i FROM scored),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n % 31 DESC, fact_id) AS k FROM p WHERE i <= 5)
SELECT e.query_id, e.fact_id, round(p.score, 9) AS score FROM e JOIN p ON e.query_id = p.query_id AND e.k = p.i UNION ALL SELECT query_id, fact_id, round(score, 9) FROM p WHERE i > 5""", "facts registry")
def k9(w: World) -> DataFrame:
    scored = _scored(w)
    facts, external = scored.select("query_id", "fact_id", "score"), scored.select("query_id", "fact_id", (F.col("n") % 31).alias("external"))
    return R.rescore_window(facts, external, 5).withColumn("score", F.round("score", 9))


@query("t1_top_k_per_query", "SELECT entity_id AS query_id, fact_id, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, fact_id)::INTEGER AS rank FROM facts QUALIFY rank <= 5", "facts")
def t1(w: World) -> DataFrame:
    return X.top_k_per_query(w.facts.withColumnRenamed("entity_id", "query_id"), "confidence", 5).select("query_id", "fact_id", "rank")


@query("t2_fact_centric", """
WITH r AS (SELECT user_id, entity_id, fact_id, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, fact_id) AS fact_rank FROM facts QUALIFY fact_rank <= 40),
f AS (SELECT *, min(fact_rank) OVER (PARTITION BY user_id, entity_id) AS m, CASE WHEN CAST(substr(entity_id, 2) AS INTEGER) % 3 = 0 THEN -CAST(substr(entity_id, 2) AS INTEGER) ELSE 1000000000 END AS p FROM r)
SELECT user_id AS query_id, entity_id, fact_id, dense_rank() OVER (PARTITION BY user_id ORDER BY p, m)::INTEGER AS entity_rank FROM f QUALIFY entity_rank <= 10""", "facts")
def t2(w: World) -> DataFrame:
    """A third of the entities were ranked before, the largest ids first."""
    hits = w.facts.select(F.coalesce("user_id", F.lit("")).alias("query_id"), "entity_id", "fact_id", F.col("confidence").alias("score"))
    number = F.substring("entity_id", 2, 99).cast("int")
    priority = hits.where(number % 3 == 0).select("query_id", "entity_id", (-number).alias("place")).distinct()
    return R.fact_centric(hits, 40, 10, priority).select(F.nullif("query_id", F.lit("")).alias("query_id"), "entity_id", "fact_id", "entity_rank")


@query("t3_keyset_page", "SELECT event_id AS id, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, event_id LIMIT 50")
def t3(w: World) -> DataFrame:
    return R.keyset_page(w.events.withColumnsRenamed({"ts": "occurred_at", "event_id": "id"}), ("2024-01-10 00:00:00", 0), 50).select("id", "event_type")


@query("t4_capped_sections", "SELECT status AS section, fact_id AS id, count(*) OVER (PARTITION BY status) > 7 AS truncated FROM facts QUALIFY row_number() OVER (PARTITION BY status ORDER BY fact_id) <= 7", "facts")
def t4(w: World) -> DataFrame:
    return R.capped_sections(w.facts.select(F.col("status").alias("section"), F.col("fact_id").alias("id")), 7)


@query("t5_profile_sections", """
WITH a AS (SELECT user_id, vertical, fact_id, count(*) OVER (PARTITION BY user_id, vertical) AS n, row_number() OVER (PARTITION BY user_id, vertical ORDER BY valid_from DESC, fact_id) AS r FROM facts WHERE user_id IS NOT NULL)
SELECT user_id, vertical AS aspect, fact_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN vertical = 'message' THEN 0 ELSE 1 END, n DESC, vertical, r)::INTEGER AS place FROM a WHERE r <= 6 QUALIFY place <= 15""", "facts")
def t5(w: World) -> DataFrame:
    facts = w.facts.where("user_id IS NOT NULL").withColumnRenamed("vertical", "aspect")
    return R.profile_sections(facts, 6, 15, "message")


@query("t6_arc_beats", """
WITH b AS (SELECT entity_id AS topic, fact_id, valid_from FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, fact_id) <= 12)
SELECT topic, fact_id, row_number() OVER (PARTITION BY topic ORDER BY valid_from, fact_id)::INTEGER AS seq FROM b""", "facts")
def t6(w: World) -> DataFrame:
    return R.arc_beats(w.facts.selectExpr("entity_id AS topic", "fact_id", "confidence AS topicality", "valid_from")).select("topic", "fact_id", "seq")


@query("t7_recent_digests", "SELECT fact_id AS digest_id FROM facts WHERE user_id IS NULL OR user_id = 'u2' ORDER BY recorded_at DESC, fact_id LIMIT 4", "facts")
def t7(w: World) -> DataFrame:
    digests = w.facts.select(F.col("fact_id").alias("digest_id"), F.array_compact(F.array("user_id")).alias("users"), F.col("recorded_at").alias("at"))
    return R.recent_digests(digests, "u2").select("digest_id")


HOPS = "a AS (SELECT DISTINCT user_id AS q, entity_id AS e FROM facts WHERE n % 3 = 0), b AS (SELECT DISTINCT user_id AS q, entity_id AS e FROM facts WHERE n % 4 = 0)"


@query("u2_combine_hops", f"""
WITH {HOPS} SELECT 'union' AS how, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'seed', count(*) FROM b""", "facts")
def u2(w: World) -> DataFrame:
    hop = lambda k: w.facts.where(f"n % {k} = 0").groupBy(F.coalesce("user_id", F.lit("")).alias("query_id"), "entity_id").agg(F.max("confidence").alias("score"))
    count = lambda how: R.combine_hops(hop(3), hop(4), how).agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "n")
    return count("union").unionByName(count("intersect")).unionByName(count("seed"))


@query("u6_merge_evidence", """
WITH base AS (SELECT * FROM facts WHERE n % 3 = 0), extra AS (SELECT * FROM facts WHERE n % 2 = 0 AND n % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, fact_id) <= 2)
SELECT entity_id AS query_id, fact_id, 0 AS source FROM base UNION ALL SELECT entity_id, fact_id, 1 FROM extra""", "facts")
def u6(w: World) -> DataFrame:
    rows = lambda cond: w.facts.where(cond).select(F.col("entity_id").alias("query_id"), "entity_id", "fact_id", F.col("confidence").alias("score"))
    return R.merge_evidence(rows("n % 3 = 0"), rows("n % 2 = 0"), 2).select("query_id", "fact_id", "source")


RANKS = "SELECT event_type AS \"group\", event_id % 14 AS rank, event_id % 11 = 0 AS absent FROM events"


@query("e1_retrieval_metrics", f"""
SELECT "group", round(avg(CASE WHEN NOT absent THEN CASE WHEN rank = 1 THEN 1.0 ELSE 0 END END), 9) AS recall_1, round(avg(CASE WHEN NOT absent THEN CASE WHEN rank BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END END), 9) AS recall_3,
 round(avg(CASE WHEN NOT absent THEN CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0 END END), 9) AS mrr,
 round(avg(CASE WHEN absent THEN CASE WHEN rank = 0 THEN 1.0 ELSE 0 END WHEN rank BETWEEN 1 AND 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 9) AS ndcg_10 FROM ({RANKS}) GROUP BY 1""")
def e1(w: World) -> DataFrame:
    results = w.events.selectExpr("event_type AS `group`", "event_id % 14 AS rank", "event_id % 11 = 0 AS absent")
    m = E.retrieval_metrics(results)
    return m.select("group", *(F.round(c, 9).alias(c) for c in m.columns[1:]))


@query("e2_bootstrap_ci")
def e2(w: World) -> DataFrame:
    return E.bootstrap_ci(w.labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("value")))


@query("e3_identity_f1", """
SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM (
 SELECT count_if(q AND t)::DOUBLE AS tp, count_if(t AND NOT q)::DOUBLE AS fp, count_if(q AND NOT t)::DOUBLE AS fn FROM (SELECT quality = 1 AS q, doc_id % 5 <> 0 AS t FROM labels))""")
def e3(w: World) -> DataFrame:
    m = E.identity_f1(w.labels.selectExpr("quality = 1 AS expected", "doc_id % 5 <> 0 AS merged"))
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


@query("e4_auc", """
WITH s AS (SELECT doc_id % 37 AS s, quality AS y FROM labels)
SELECT round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 9) AS auc FROM s a JOIN s b ON a.y = 1 AND b.y = 0""")
def e4(w: World) -> DataFrame:
    return E.auc(w.labels.selectExpr("doc_id % 37 AS score", "quality AS label")).withColumn("auc", F.round("auc", 9))


ANSWER_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({}), '\\b(a|an|the)\\b|[^\\w\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def _answers(w: World) -> DataFrame:
    """Each turn against the next one of its conversation."""
    following = w.conversations.selectExpr("conv_id", "turn - 1 AS turn", "text AS expected")
    return w.conversations.join(following, ["conv_id", "turn"]).selectExpr("concat(conv_id, ':', turn) AS id", "text AS answer", "expected")


@query("e5_token_overlap", f"""
WITH t AS (SELECT concat(a.conv_id, ':', a.turn) AS id, {ANSWER_TOKENS.format('a.text')} AS a, {ANSWER_TOKENS.format('b.text')} AS e FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT id, unnest(a) AS w FROM t), y AS (SELECT id, unnest(e) AS w FROM t),
c AS (SELECT id, sum(least(n, m)) AS c FROM (SELECT id, w, count(*) AS n FROM x GROUP BY 1, 2) JOIN (SELECT id, w, count(*) AS m FROM y GROUP BY 1, 2) USING (id, w) GROUP BY 1)
SELECT id, a = e AS exact, round(CASE WHEN c > 0 THEN 2.0::DOUBLE * c / (len(a) + len(e)) ELSE 0 END, 9) AS f1,
 round(CASE WHEN len(a) = 0 THEN 0 ELSE coalesce(c, 0)::DOUBLE / len(a) * CASE WHEN len(a) >= len(e) THEN 1 ELSE exp(1 - len(e)::DOUBLE / len(a)) END END, 9) AS bleu1 FROM t LEFT JOIN c USING (id)""")
def e5(w: World) -> DataFrame:
    return E.token_overlap(_answers(w)).select("id", "exact", F.round("f1", 9).alias("f1"), F.round("bleu1", 9).alias("bleu1"))


@query("e5_rouge_l")
def e5b(w: World) -> DataFrame:
    return E.token_overlap(_answers(w)).select("id", F.round("rouge_l", 9).alias("rouge_l"))


JOINT = """
WITH s AS (SELECT c_nationkey AS id, {0}(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END) AS a, {0}(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END) AS ae,
 {0}(CASE WHEN c_custkey % 5 = 0 THEN c_custkey END) AS s, {0}(CASE WHEN c_custkey % 7 = 0 AND c_nationkey % 4 <> 0 THEN c_custkey END) AS se FROM customer GROUP BY 1)"""


@query("e3_joint_f1", f"""{JOINT.format('list')},
n AS (SELECT id, len(list_filter(a, lambda x: x IS NOT NULL)) AS p, len(list_filter(ae, lambda x: x IS NOT NULL)) AS e, len(list_filter(a, lambda x: x IS NOT NULL AND list_contains(ae, x))) AS b,
 len(list_filter(s, lambda x: x IS NOT NULL)) AS sp, len(list_filter(se, lambda x: x IS NOT NULL)) AS se, len(list_filter(s, lambda x: x IS NOT NULL AND list_contains(se, x))) AS sb FROM s),
m AS (SELECT id, CASE WHEN p = 0 AND e = 0 THEN 1 WHEN p = 0 THEN 0 ELSE b::DOUBLE / p END AS ap, CASE WHEN e = 0 THEN 1 ELSE b::DOUBLE / e END AS ar,
 CASE WHEN sp = 0 AND se = 0 THEN 1 WHEN sp = 0 THEN 0 ELSE sb::DOUBLE / sp END AS tp, CASE WHEN se = 0 THEN 1 ELSE sb::DOUBLE / se END AS tr FROM n)
SELECT id, round(CASE WHEN ap + ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0 END, 9) AS answer_f1, round(CASE WHEN tp + tr > 0 THEN 2 * tp * tr / (tp + tr) ELSE 0 END, 9) AS support_f1,
 round(CASE WHEN ap * tp + ar * tr > 0 THEN 2 * ap * tp * ar * tr / (ap * tp + ar * tr) ELSE 0 END, 9) AS joint_f1 FROM m""")
def e3b(w: World) -> DataFrame:
    sets = lambda cond: F.collect_list(F.when(F.expr(cond), F.col("c_custkey")))
    found = w.customer.groupBy(F.col("c_nationkey").alias("id")).agg(
        sets("c_custkey % 3 = 0").alias("answers"), sets("c_custkey % 2 = 0").alias("expected_answers"),
        sets("c_custkey % 5 = 0").alias("support"), sets("c_custkey % 7 = 0 AND c_nationkey % 4 <> 0").alias("expected_support"),
    )
    return E.joint_f1(found).select("id", *(F.round(c, 9).alias(c) for c in ("answer_f1", "support_f1", "joint_f1")))


@query("e6_regression_gate", """
WITH m AS (SELECT event_type AS metric, avg(value) AS v, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS b FROM events GROUP BY 1) SELECT metric, b - v > 0.03 AS blocked FROM m""")
def e6(w: World) -> DataFrame:
    run = w.events.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    base = w.events.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return E.regression_gate(run, base).select("metric", "blocked")
