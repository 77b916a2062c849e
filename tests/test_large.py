"""Paths that only large tables take, on small ones."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import graph, lexical, neighbours, search, similarity, text
from factloom.operators.sessions import best_mention_per_session


def test_names_and_entities_of_one_table_meet_in_blocks(spark, monkeypatch):
    """more queries than are broadcast, whose columns are those of the vectors' table."""
    rows = spark.createDataFrame([(i, f"t{i % 3}", f"n{i}", [1.0, i / 50]) for i in range(60)], "entity_id int, type string, canonical_name string, embedding array<double>")
    names = rows.selectExpr("entity_id AS name_id", "type", "CASE WHEN entity_id % 2 = 0 THEN canonical_name ELSE 'x' END AS name", "embedding AS q")
    found = lambda: sorted((r.name_id, r.entity_id, r.how) for r in search.match_entities(names, rows).collect())
    whole = found()
    monkeypatch.setattr(neighbours, "BROADCAST", 16)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    assert found() == whole == [(i, i, "vector" if i % 2 else "name") for i in range(60)]


def plain_scan(topics, segments, floor=0.35, share=0.9, most=60):
    """Each topic's lines one topic at a time."""
    close = neighbours.within(topics.select("query_id", "q"), segments, floor, share)
    said = lexical.any_term_scores(topics.select("query_id", "text"), segments, ["text"]).select("query_id", "fact_id", F.round("bm25", 9).alias("lexical"))
    both = close.join(said, ["query_id", "fact_id"], "full").na.fill(0.0, ["similarity", "lexical"]).join(segments.drop("embedding"), "fact_id")
    seq = F.row_number().over(W.partitionBy("query_id").orderBy("occurred_at", "fact_id"))
    lines = text.dedupe_mentions(best_mention_per_session(both).withColumn("seq", seq).select("query_id", "seq", "text"))
    return lines.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("seq"))).where(F.col("n") <= most).drop("n")


def test_topics_with_the_same_terms_are_scanned_once(spark, rows, monkeypatch):
    """what matches by word is not made topic by topic, and each topic has the lines it had."""
    rng = random.Random(7)
    words = "red green blue phone status urgent high low".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 6))))
    vector = lambda: [rng.choice((-1.0, 0.0, 1.0)) for _ in range(4)]
    segments = spark.createDataFrame([(f"f{i}", rng.randrange(70), rng.randrange(40), line(), vector()) for i in range(400)], "fact_id string, session_key int, occurred_at int, text string, embedding array<double>")
    said = ("red status", "status red", "to be", "low", None)
    topics = spark.createDataFrame([(i, said[i % 5], vector()) for i in range(25)], "query_id int, text string, q array<double>")
    scored, plain = [], lexical.any_term_scores
    want = rows(plain_scan(topics, segments, most=9))
    monkeypatch.setattr(lexical, "any_term_scores", lambda queries, *a, **k: scored.append(queries.count()) or plain(queries, *a, **k))
    assert rows(search.mention_scan(topics, segments, most=9)) == want and len(want) > 60
    assert scored == [4]


def test_only_what_reaches_the_nth_nearest_leaves_a_block(spark, rows):
    """vectors that are near enough, but behind a query's fifth, are not given; ties with the fifth are."""
    vectors = spark.createDataFrame([(i, [1.0, (i // 3) / 100]) for i in range(300)], "fact_id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "query_id int, q array<double>")
    got = rows(neighbours.within(queries, vectors, 0.7, 1.0, 5).select("query_id", "fact_id"))
    assert got == sorted([(1, i) for i in range(6)] + [(3, 297), (3, 298), (3, 299)], key=str)
    best = neighbours.Best(neighbours.Matrix([1], None, pa.array([[1.0, 0.0]]), np.array([0.0])), None, 0.0)
    met = best.meet(neighbours.Matrix(list(range(2 * neighbours.GIVEN + 1)), None, pa.array([[1.0, 0.0]] * (2 * neighbours.GIVEN + 1))))
    assert [len(x) for x in met] == [neighbours.GIVEN, neighbours.GIVEN, 1]


def test_stems_are_made_of_distinct_words(spark, rows):
    """no Python over the texts' words row by row, and the same postings."""
    docs = spark.createDataFrame([(1, "Running runs RUN ran élan"), (2, "a run, a runner élans"), (3, ""), (4, None)], "doc_id int, text string")
    terms = spark.createDataFrame([("run",), ("elan",)], "term string")
    for places in (False, True):
        made = lexical.postings(docs, terms, "text", "doc_id", lexical.stemmed, places)
        assert rows(made) == rows(lexical.postings(docs, terms, "text", "doc_id", lambda t: lexical.stemmed(t), places))
        assert "ArrowEvalPython" not in made._jdf.queryExecution().toString()


def test_the_signs_of_masks_are_in_all_texts_that_are_masked(spark):
    """a plainer rule passes texts over."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé@._-+ ()\t\n " + "0123456789" * 2) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 30 + "@b.cd", "1 2 3 4 5 6 7 8 9", "x123456789y"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for name, rule, mask, sign in text.MASKS:
        hit = df.where(F.regexp_replace("text", rule, mask) != F.col("text"))
        assert hit.count() and hit.where(~F.regexp_like("text", F.lit(sign))).isEmpty(), name
    out = df.withColumn("whole", F.col("text"))
    for _, rule, mask, _ in text.MASKS:
        out = out.withColumn("whole", F.regexp_replace("whole", rule, mask))
    assert text.redact_pii(out).where("NOT text <=> whole").isEmpty()


def test_ranks_of_nodes_in_many_queries(spark, monkeypatch):
    """ends that are in many queries give the same ranks, and no window holds a query or a node's edges."""
    rng, plans, write = random.Random(9), [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df))
    links = [(f"c{i}", f"s{rng.randrange(5)}", rng.choice((0.2, 0.5, 1.0))) for i in range(30) for _ in range(2)]
    seeds = [(i % 3, f"c{i}", 1.0 + i % 2) for i in range(32)] + [(q, f"s{j}", 0.5) for q in range(3) for j in range(6)]
    ranks = graph.personalized_pagerank(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(seeds, "query_id int, node string, score double"))
    got = {(r.query_id, r.node): r.rank for r in ranks.collect()}
    assert len(got) == len(seeds) and not any("Window" in p for p in plans)
    for q in range(3):
        seed = {n: s for i, n, s in seeds if i == q}
        seed = {n: s / sum(seed.values()) for n, s in seed.items()}
        ways = [(a, b, w) for a, b, w in [*links, *((b, a, w) for a, b, w in links)] if a in seed and b in seed]
        out = {n: sum(w for a, _, w in ways if a == n) for n in seed}
        rank = dict(seed)
        for _ in range(3):
            lost = sum(rank[n] for n in seed if not out[n])
            rank = {n: 0.15 * seed[n] + 0.85 * (sum(rank[a] * w / out[a] for a, b, w in ways if b == n) + seed[n] * lost) for n in seed}
        assert all(abs(rank[n] - got[q, n]) < 1e-12 for n in seed)


def test_the_newest_facts_of_reached_entities_need_no_order(spark, rows):
    """F16: facts of others take no part, and of equal times the larger id is the newest."""
    table = lambda data, schema: spark.createDataFrame(data, schema)
    known = table([("a", "Ann"), ("b", "Bob"), ("c", "Cid")], "entity_id string, canonical_name string")
    facts = table([("a", "p", "x", 1, "f1"), ("a", "p", "x", 1, "f2"), ("a", "p", None, 3, "f3"), ("a", "p", None, 2, "f9"), ("b", "phone", "y", 1, "f4"), ("b", "p", "y", 2, "f5"), ("c", "phone", "z", 1, "f6")],
        "entity_id string, predicate string, object string, valid_from int, fact_id string")
    found = graph.graph_retrieve(table([(1, "ANN")], "query_id int, name string"), known, table([("b", "a")], "src string, dst string"), facts, ["phone"])
    assert rows(found) == [(1, "a", "f2", 0.5), (1, "a", "f3", 0.5), (1, "b", "f4", 0.7)]
    assert "Window" not in found._jdf.queryExecution().toString()


def test_texts_that_many_facts_share_are_scored_once(spark, rows, monkeypatch):
    """and so are queries that differ only in words that no fact has; the facts found are the same."""
    rng = random.Random(5)
    said = ["red status", "blue status low", "high", "low red red", "", None]
    facts = spark.createDataFrame([(f"f{i}", rng.choice(said), rng.choice(said)) for i in range(300)], "fact_id string, haystack string, object string")
    queries = spark.createDataFrame([(i, f"{('red low', 'STATUS blue', 'high')[i % 3]} unknown{i}") for i in range(9)], "query_id int, text string")
    plain = None
    for f in ("haystack", "object"):
        one = lexical.bm25_terms(queries, facts, f, "fact_id").groupBy("query_id", "fact_id").agg(F.round(F.sum("weight"), 9).alias("bm25"))
        one = lexical.top_k_per_query(one, "bm25", 7)
        plain = one if plain is None else plain.unionByName(one)
    plain = lexical.top_k_per_query(plain.groupBy("query_id", "fact_id").agg(F.max("bm25").alias("bm25")), "bm25", 7)
    want = rows(plain.select("query_id", "fact_id", "rank", "bm25"))
    seen, keep = [], lexical.best_sums
    monkeypatch.setattr(lexical, "best_sums", lambda asked, made, *more: seen.append((asked.select("query_id").distinct().count(), made.select("fact_id").distinct().count())) or keep(asked, made, *more))
    assert rows(lexical.bm25_fields(queries, facts, ["haystack", "object"], 7).select("query_id", "fact_id", "rank", "bm25")) == want and len(want) == 63
    assert seen == [(3, 4), (3, 4)]


def test_vectors_that_many_facts_share_are_scored_once(spark, rows, monkeypatch):
    """of equal similarities, of one vector or of several, the least facts are the nearest."""
    rng = random.Random(6)
    given = [(i, [1.0, (i // 2) / 10] if i != 7 else None) for i in range(12)]
    vectors = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    facts = spark.createDataFrame([(f"f{i}", rng.choice((*range(9), 99, None))) for i in range(200)], "fact_id string, vec_id long")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.2])], "query_id int, q array<double>")
    plain = lambda k: rows(neighbours.exact_knn(queries, facts.join(vectors, "vec_id").where("embedding IS NOT NULL"), k).select("query_id", "fact_id", "rank"))
    want, met = {k: plain(k) for k in (1, 5, 60, 500)}, []
    assert all(rows(similarity.shared_knn(queries, facts, vectors, k).select("query_id", "fact_id", "rank")) == want[k] for k in want)
    monkeypatch.setattr(similarity, "exact_knn", lambda asked, held, k: met.append(held.count()) or neighbours.exact_knn(asked, held, k))
    assert similarity.shared_knn(queries, facts, vectors, 5).count() == 15 and met == [8]


def test_a_running_sum_is_dealt_out_by_its_order(spark, rows):
    """the lines of one group go to several tasks, and lines at one place have one sum."""
    rng = random.Random(8)
    given = spark.createDataFrame([(rng.choice("aab"), rng.randrange(60), rng.randrange(3), i) for i in range(400)], "g string, x int, v int, id int")
    got = search.running_sum(given, "g", ("x",), "v", "s")
    assert rows(got) == rows(given.withColumn("s", F.sum("v").over(W.partitionBy("g").orderBy("x"))))
    assert "__part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_that_share_texts_and_vectors_are_scanned_as_if_each_had_its_own(spark, rows, monkeypatch):
    """F2: a text and a vector are scored once, and the lines are those of a scan topic by topic."""
    rng = random.Random(11)
    said = ["red status now", "blue red status", "status of the high", "low", "urgent red blue green", None]
    vectors = spark.createDataFrame([(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(4)]) for i in range(20)], "vec_id long, embedding array<double>")
    lines = spark.createDataFrame([(f"f{i}", rng.randrange(60), rng.randrange(40), rng.choice(said), rng.randrange(20)) for i in range(300)], "fact_id string, session_key int, occurred_at int, text string, vec_id long")
    topics = spark.createDataFrame([(i, ("red status", "low", "of the")[i % 3], [1.0, i / 4, 0.0, -1.0]) for i in range(9)], "query_id int, text string, q array<double>")
    want = rows(plain_scan(topics, lines.join(vectors, "vec_id"), most=9))
    scored, plain, near = [], lexical.any_term_scores, search.within
    monkeypatch.setattr(lexical, "any_term_scores", lambda queries, docs, *a: scored.append(docs.count()) or plain(queries, docs, *a))
    monkeypatch.setattr(search, "within", lambda asked, held, *a: scored.append(held.count()) or near(asked, held, *a))
    assert rows(search.mention_scan(topics, lines, most=9, vectors=vectors)) == want and len(want) > 20
    assert scored == [6, 20]
