"""Lexical scores: the pruned k best against all sums, phrases, topics and stems."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions.stems import english, stem
from factloom.operators import lexical

# Words of the algorithm's published examples with their stems.
STEMS = (
    "consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori "
    "conspicuous conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knackeries knackeri knees knee knitting knit knives knive "
    "knotted knot knuckles knuckl ties tie cries cri gas gas this this gaps gap kiwis kiwi caresses caress luxuriously luxuri hoping hope hopping hop falling fall "
    "happy happi by by say say generate generat communism communism arsenal arsenal relational relat conditional condit rational ration digitizer digit operator oper "
    "feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative format formalize formal electrical electr goodness good revival reviv "
    "allowance allow inference infer adjustable adjust replacement replac adoption adopt rate rate cease ceas controlling control roll roll skies sky dying die "
    "inning inning proceed proceed bed bed agreed agre feed feed is is ox ox yes yes youth youth boyish boyish sensibility sensibl"
).split()


def test_stems():
    got = {w: stem(w) for w in STEMS[::2]}
    assert got == dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert (english("cafés"), english("naïve"), stem("東京"), stem("x1s"), english("ñandúes")) == ("cafe", "naiv", "東京", "x1s", "nandu")


def test_stemming_joins_what_plain_words_keep_apart(spark):
    docs = spark.createDataFrame([(1, "The cafés were closing"), (2, "closed cafe"), (3, "an open door"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "CLOSE CAFE")], "query_id int, text string")
    assert {r.doc_id for r in lexical.bm25(asked, docs, 5).collect()} == {2}
    assert {r.doc_id for r in lexical.bm25(asked, docs, 5, analysis=lexical.stemmed).collect()} == {1, 2}


def made(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    odds = [1 / (i + 1) for i in range(60)]
    return [" ".join(rng.choices(vocab, odds, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("first", [1, 20])
def test_the_k_best_are_those_of_all_sums(spark, monkeypatch, first):
    monkeypatch.setattr(lexical, "FIRST", first)
    docs = spark.createDataFrame(list(enumerate([*made(1, 250), "w0", "w0", None])), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate([*made(2, 25), "w0", "w0 w1 w59", "none", None])), "query_id int, text string")
    every = lexical.bm25_terms(asked, docs).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("bm25"))
    for k in (1, 5, 1 << 30):
        want = {(r.query_id, r["rank"]): (r.doc_id, round(r.bm25, 9)) for r in lexical.top_k_per_query(every.withColumn("bm25", F.round("bm25", 9)), "bm25", k, "doc_id").collect()}
        got = {(r.query_id, r["rank"]): (r.doc_id, round(r.bm25, 9)) for r in lexical.bm25(asked, docs, k).collect()}
        assert got.keys() == want.keys() and all(got[q][1] == want[q][1] for q in got)


def test_frequent_terms_are_only_looked_up(spark, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 1)
    docs = spark.createDataFrame([(i, "the " * 3 + ("rare " * (1 + i % 3) if i < 30 else "") + f"x{i}") for i in range(2000)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "the rare")], "query_id int, text string")
    seen = []
    keep = lexical.written
    monkeypatch.setattr(lexical, "written", lambda df: seen.append(keep(df)) or seen[-1])
    assert len(lexical.bm25(asked, docs, 3).collect()) == 3
    assert [(r.term, r.looked_up) for r in seen[-1].collect()] == [("the", True)] and seen[-2].count() == 30


def test_phrases_and_topics(spark):
    docs = spark.createDataFrame([(1, "to be or not", "x"), (2, "be to", "y"), (3, "x", "we want to, be"), (4, "to to be be", None), (5, None, "item about apples"), (6, "The apples and pears", "none")], "fact_id int, a string, b string")
    topics = spark.createDataFrame([(1, "to be"), (2, "The item about apples"), (3, "be be"), (4, ""), (5, None), (6, "nothing here"), (7, "PEARS, apples?")], "query_id int, text string")
    got = {}
    for r in lexical.bm25_any_term(topics, docs, ["a", "b"], 10).collect():
        got.setdefault(r.query_id, []).append(r.fact_id)
    assert {q: sorted(ids) for q, ids in got.items()} == {1: [1, 3, 4], 2: [5, 6], 3: [4], 7: [5, 6]} and got[7][0] == 6
    scores = {(r.query_id, r.fact_id) for r in lexical.any_term_scores(topics, docs, ["a", "b"]).collect()}
    assert scores == {(q, i) for q, ids in got.items() for i in ids}


def test_queries_with_the_same_terms_are_scored_once(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(made(3, 80))), "doc_id int, text string")
    asked = spark.createDataFrame([(i, ["w1 w0", "W0 w1 w1", "w5"][i % 3]) for i in range(30)], "query_id int, text string")
    seen, keep = [], lexical.best_sums
    monkeypatch.setattr(lexical, "best_sums", lambda asked, *more: seen.append(asked.select("query_id").distinct().count()) or keep(asked, *more))
    got = {}
    for r in lexical.bm25(asked, docs, 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.bm25))
    assert seen == [2] and len(got) == 30
    assert all(sorted(got[i]) == sorted(got[0 if i % 3 < 2 else 2]) for i in got)


def test_equal_texts_tie_whatever_order_their_weights_are_summed_in(spark):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit."""
    given = [(2, "a", 0.1), (2, "b", 0.2), (2, "c", 0.3), (1, "a", 0.3), (1, "b", 0.2), (1, "c", 0.1)]
    made_ = spark.createDataFrame(given, "doc_id int, term string, weight double").coalesce(1)
    asked = spark.createDataFrame([(7, t) for t in "abc"], "query_id int, term string")
    for rows in (made_, made_.orderBy(F.desc("term"))):
        assert [(r.doc_id, r.bm25) for r in lexical.best_sums(asked, rows, 1, "doc_id").collect()] == [(1, 0.6)]


def test_sums_made_document_by_document_are_the_same(spark, rows, monkeypatch):
    """many queries meet each document at once, however few of their terms are sent to a task in one pass."""
    docs = spark.createDataFrame(list(enumerate([*made(4, 150), "w0", "w0", None])), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate([*made(5, 12), "w0", "w0 w1 w59", "none", None])), "query_id int, text string")
    best = lambda k: rows(lexical.bm25(asked, docs, k).select("query_id", "rank", "doc_id", F.round("bm25", 9)))
    want = {k: best(k) for k in (2, 1 << 30)}
    monkeypatch.setattr(lexical, "MET", 0)
    monkeypatch.setattr(lexical, "HELD", 60)
    monkeypatch.setattr(lexical, "AT_ONCE", 100)
    assert all(best(k) == want[k] for k in want)


def test_the_stemmed_query_asks_every_item(spark, tmp_path):
    """not one item in ten."""
    from factloom.plans import QUERIES

    spark.createDataFrame([(i, f"closing cafés number{i}") for i in range(23)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"the cafe number{i} closed") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["k3_bm25_stemmed"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(range(23)) and len(got) == 230


def test_words_are_distinct_before_they_are_stemmed(spark, monkeypatch):
    """Spark does not stem the words of all rows to find those without a stem."""
    plans, keep = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    docs = spark.createDataFrame([(1, "Running runs")], "doc_id int, text string")
    lexical.postings(docs, spark.createDataFrame([("run",)], "term string"), "text", "doc_id", lexical.stemmed)
    assert any("ArrowEvalPython" in p for p in plans) and not any("ArrowEvalPython" in p and "explode" in p for p in plans)
