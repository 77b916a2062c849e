"""Boundary cases of operators and comparisons with plain folds."""

import math
import random
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.operators import evaluation, graph, intervals, maintenance, neighbours, retrieval, sessions, similarity, temporal, text, trust
from factloom.operators.resolution import Config, fold_slot, resolve_facts
from factloom.sources import readers

FACT = "fact_id string, entity_id string, predicate string, object string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, retracted_at timestamp, status string, superseded_by string, prior_valid_until timestamp"


def fact(i, start, end=None, **kw):
    row = {"fact_id": i, "entity_id": "e", "predicate": "p", "object": "o", "valid_from": start, "valid_until": end, "recorded_at": start, "retracted_at": None, "status": "active", "superseded_by": None, "prior_valid_until": None}
    return tuple((row | kw).values())


@pytest.mark.parametrize(
    ("a", "b", "meets"),
    [((4, 1, None), (1, 1, (4, 1)), False), ((4, 1, None), (1, 1, None), True), ((3, 15, None), (1, 1, (4, 1)), True), ((4, 1, (5, 1)), (4, 15, None), True)],
)
def test_half_open_overlap(spark, a, b, meets):
    made = [spark.createDataFrame([fact(n, dt(2024, m, d), e and dt(2024, *e))], FACT) for n, (m, d, e) in (("a", a), ("b", b))]
    assert intervals.overlap_join(*made, ["entity_id", "predicate"]).count() == int(meets)


def test_old_value_stays_until_a_future_successor_starts(spark):
    facts = spark.createDataFrame([fact("old", dt(2024, 1, 1), dt(2025, 1, 1), status="superseded", superseded_by="new"), fact("new", dt(2025, 1, 1), recorded_at=dt(2024, 6, 1))], FACT)
    now = lambda t: sorted(r.fact_id for r in temporal.current_facts(facts, f"TIMESTAMP '{t}'").collect())
    assert now("2024-07-01") == ["old"] and now("2025-01-01") == ["new"]
    believed = temporal.facts_believed_at(facts, "TIMESTAMP '2024-05-01'", "TIMESTAMP '2026-01-01'").collect()
    assert [r.fact_id for r in believed] == ["old"]


@pytest.mark.parametrize(("seconds", "n"), [(3600, 1), (3601, 2)])
def test_session_gap(spark, seconds, n):
    at = dt(2024, 1, 1)
    turns = spark.createDataFrame([("a", "c", at), ("b", "c", dt.fromtimestamp(at.timestamp() + seconds))], "turn_id string, conversation_id string, occurred_at timestamp")
    assert sessions.sessionize(turns).select("session").distinct().count() == n


@pytest.mark.parametrize(("turns", "windows"), [(1, 1), (4, 1), (5, 2), (6, 2), (7, 3)])
def test_segment_windows(spark, turns, windows):
    rows = [(f"t{i}", "c", dt(2024, 1, 1, 0, i), 0, "x") for i in range(turns)]
    made = sessions.segment_windows(spark.createDataFrame(rows, "turn_id string, conversation_id string, occurred_at timestamp, session int, text string")).collect()
    assert len(made) == windows and max(made, key=lambda r: r.start).turn_ids[-1] == f"t{turns - 1}"


def test_one_of_two_best_facts_counts_for_the_boost(spark):
    rows = [("q", "e", "p", "alpha alpha", 1.0), ("q", "e", "p", "beta beta", 1.0), ("q", "e", "p", "beta  beta", 0.9), ("q", "e", "p", "gamma ray", 0.5), ("q", "e", "p", "delta ray", 0.4)]
    got = retrieval.bucket_entities(spark.createDataFrame(rows, "query_id string, entity_id string, predicate string, object string, score double")).first()
    assert (got.best, round(got.rank_score, 9)) == (1.0, 1.45)


def test_isotonic_pools_falling_neighbours(spark):
    pairs = [(0.05, 0)] * 4 + [(0.15, 1)] * 3 + [(0.15, 0)] + [(0.25, 0)] * 2 + [(0.25, 1)] * 2 + [(0.95, 1)] * 5
    step = trust.fit_isotonic(spark.createDataFrame(pairs, "raw double, correct int")).first()
    assert step.thresholds == [0.1, 0.3, 1.0] and [round(v, 6) for v in step["values"]] == [0.0, 0.625, 1.0] and step.samples == 17
    look = spark.createDataFrame([(0.1,), (0.2,), (0.31,)], "c double").select(trust.calibrate(F.col("c"), F.lit(step.thresholds), F.lit(step["values"])).alias("v"))
    assert [round(r.v, 6) for r in look.collect()] == [0.0, 0.625, 1.0]


def test_pagerank_gives_isolated_mass_back(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0), ("q", "c", 0.5), ("q", "lone", 0.5)], "query_id string, node string, score double")
    seed = {"a": 0.5, "b": 0.25, "c": 0.125, "lone": 0.125}
    share = {("a", "b"): 1.0, ("b", "a"): 0.25, ("b", "c"): 0.75, ("c", "b"): 1.0}
    want = dict(seed)
    for _ in range(3):
        want = {n: 0.15 * seed[n] + 0.85 * (sum(want[s] * w for (s, d), w in share.items() if d == n) + seed[n] * want["lone"]) for n in seed}
    got = {r.node: r.rank for r in graph.personalized_pagerank(edges, seeds).collect()}
    assert all(math.isclose(got[n], want[n], rel_tol=1e-9) for n in seed) and math.isclose(sum(got.values()), 1)


def test_components_of_a_long_chain(spark):
    links = spark.range(300).selectExpr("concat('n', lpad(id, 4, '0')) AS a", "concat('n', lpad(id + 1, 4, '0')) AS b")
    roots = graph.components(links.union(spark.createDataFrame([("x", "y")], "a string, b string"))).collect()
    assert {r.root for r in roots} == {"n0000", "x"} and len(roots) == 303


def test_communities_keep_two_cliques_apart(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    found = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert len({found[f"a{i}"] for i in range(5)}) == 1 and found["a1"] != found["b1"]


def test_communities_as_in_plain_rounds_without_shuffling_edges(spark, monkeypatch):
    """Labels as by a loop over nodes; a first round deals out labels twice and votes once, and edges never."""
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", rng.choice([0.0, 0.25, 0.5, 1.0, 2.0])) for _ in range(150)]
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)) if a != b else ():
            near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0.0) + (w or 1.0)
    want = {n: n for n in near}
    for step in range(1, 11):
        new = {}
        for n, to in near.items():
            votes = {}
            for m, w in to.items():
                votes[want[m]] = votes.get(want[m], 0.0) + w
            best = min((-v, c) for c, v in votes.items())[1]
            new[n] = best if step % 2 or best < want[n] else want[n]
        if new == want:
            break
        want = new
    plans, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: (plans.append(df._jdf.queryExecution().sparkPlan().toString() if "old" not in df.columns else df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    turns = [p.split("Initial Plan")[-1] for p in plans if "old#" in p]
    assert len(turns) > 2 and turns[0].count("Exchange ") <= 3 and all(p.count("Exchange ") <= 4 for p in turns)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edges_")]


def test_closure_survives_cycles(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), ("z", "y")], "fact_id string, parent string")
    assert sorted(r.fact_id for r in graph.derived_closure(links, spark.createDataFrame([("a",)], "fact_id string")).collect()) == ["b", "c"]


def test_closure_rounds_shuffle_no_links(spark, monkeypatch):
    """A shared child, a cycle and a chain; links are not dealt out again in each round, neither of few new facts nor of many."""
    from pyspark.sql import DataFrameWriter

    pairs = [(f"f{2 * i + k}", f"f{i}") for i in range(1, 40) for k in (0, 1)] + [("f3", "f70"), ("f9", "f5"), (None, "f2"), ("x", None), ("loop", "loop")]
    links = spark.createDataFrame(pairs, "fact_id string, parent string")
    want, new = set(), {"f2", "loop"}
    while new:
        new = {a for a, b in pairs if b in new and a} - want - {"f2", "loop"}
        want |= new
    plans, kept = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), kept(self, *a, **k))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, few in ((2, None), (3, 0)):
            if few is not None:
                monkeypatch.setattr(graph, "FEW", few)
            plans.clear()
            got = graph.derived_closure(links, spark.createDataFrame([("f2",), ("loop",), ("f2",), (None,)], "fact_id string"))
            assert sorted(r.fact_id for r in got.where("fact_id IS NOT NULL").collect()) == sorted(want)
            rounds = [p for p in plans if "parent" in p]
            assert len(rounds) > 3 and all(p.count("Exchange hashpartitioning") <= most for p in rounds)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("links_")]


def slot_row(i, start, **kw):
    base = {"fact_id": f"f{i}", "object": "x", "semantics": "bitemporal", "confidence": 0.9, "declared_trust": 0.9, "learned_trust": 0.5, "authority": 0.0, "origin_key": f"o{i}", "embedding": [1.0, 0.0],
            "valid_from": start, "valid_until": None, "recorded_at": dt(2024, 3, 1, 0, i)}
    return base | kw


NOW = dt(2024, 6, 1)


def outcomes(rows):
    done = sorted(fold_slot(rows, NOW, Config()), key=lambda r: r["fact_id"])
    return [(r["outcome"], r["status"]) for r in done]


def test_resolution_boundary_cases():
    day = lambda d: dt(2024, 1, d)
    assert outcomes([slot_row(1, day(1)), slot_row(2, day(2))]) == [("INSERTED", "active"), ("CORROBORATED", "corroborating")]
    assert outcomes([slot_row(1, day(1)), slot_row(2, day(2), origin_key="o1", confidence=0.2)])[1][0] == "COMPETING"
    assert outcomes([slot_row(1, day(1)), slot_row(2, day(2), origin_key="o1")])[1][0] == "SUPERSEDED"
    assert outcomes([slot_row(1, day(1)), slot_row(2, day(2), object="y", confidence=0.1, declared_trust=0.1)])[1] == ("REJECTED", "rejected")
    late = [slot_row(1, day(5), semantics="single_active"), slot_row(2, day(2), object="y", semantics="single_active")]
    assert outcomes(late) == [("INSERTED", "active"), ("INSERTED_HISTORICAL", "superseded")]
    assert [r["valid_until"] for r in fold_slot(late, NOW, Config()) if r["fact_id"] == "f2"] == [day(5)]
    three = [slot_row(1, day(1), semantics="events", object="a"), slot_row(2, day(3), semantics="events", object="b"), slot_row(3, dt(2024, 1, 3, 9), semantics="events", object="c")]
    assert outcomes(three) == [("INSERTED", "superseded"), ("SUPERSEDED", "competing"), ("COMPETING", "competing")]
    apart = [slot_row(1, day(1)), slot_row(2, day(2), object="y", embedding=[0.0, 1.0])]
    assert outcomes(apart) == [("INSERTED", "active")] * 2


def test_resolution_on_spark_is_the_plain_fold(spark):
    rng = random.Random(7)
    rows = [slot_row(i, dt(2024, 1, rng.randint(1, 9)), object=rng.choice("xyz"), origin_key=rng.choice("abc"), semantics=s, entity_id=s, predicate="p", user_id=None, derived_version=None, embedding=rng.choice([[1.0, 0.0], [1.0, 0.2], [0.0, 1.0]]), confidence=rng.random())
            for s in ("single_active", "bitemporal", "events") for i in range(40)]
    for k, r in enumerate(rows):
        r["fact_id"] = f"{r['entity_id']}{k:03d}"
    schema = "fact_id string, object string, semantics string, confidence double, declared_trust double, learned_trust double, authority double, origin_key string, embedding array<double>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, entity_id string, predicate string, user_id string, derived_version string"
    names = [c.split()[0] for c in schema.split(", ")]
    made = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    got = {r.fact_id: (r.outcome, r.status, r.superseded_by, r.corroborates) for r in resolve_facts(made, "2024-06-01").collect()}
    for s in ("single_active", "bitemporal", "events"):
        for r in fold_slot([dict(r) for r in rows if r["semantics"] == s], NOW, Config()):
            assert got[r["fact_id"]] == (r["outcome"], r["status"], r["superseded_by"], r["corroborates"])


def test_dead_facts_are_no_opponents_and_aliases_meet(spark):
    schema = "fact_id string, object string, semantics string, confidence double, declared_trust double, learned_trust double, authority double, origin_key string, embedding array<double>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, entity_id string, predicate string, user_id string, derived_version string, predicate_alias string, stored boolean, status string, retracted_at timestamp"
    base = {"entity_id": "e", "predicate": "p", "user_id": None, "derived_version": None, "predicate_alias": None, "stored": False, "status": None, "retracted_at": None, "semantics": "single_active"}
    day = lambda d: dt(2024, 1, d)
    rows = [
        slot_row(1, day(1), **base | {"stored": True, "status": "active", "retracted_at": day(9)}), slot_row(2, day(2), **base | {"stored": True, "status": "superseded"}),
        slot_row(3, day(3), **base | {"stored": True, "status": "active"}, object="old"), slot_row(4, day(4), **base | {"predicate": "coined", "predicate_alias": "p"}, object="new"),
        slot_row(5, day(1), **base | {"entity_id": "f", "stored": True, "status": "active", "retracted_at": day(9)}, object="old"), slot_row(6, day(4), **base | {"entity_id": "f"}, object="new"),
    ]
    names = [c.split()[0] for c in schema.split(", ")]
    facts = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    got = {r.fact_id: (r.outcome, r.status, r.superseded_by) for r in resolve_facts(facts, "2024-06-01").collect()}
    assert got == {"f3": (None, "superseded", "f4"), "f4": ("SUPERSEDED", "active", None), "f6": ("INSERTED", "active", None)}


def append_by_hand(rows):
    """append_only by the rule: the latest earlier active fact of another origin."""
    active, out = [r for r in rows if r[4] and r[5] == "active"], {}
    for r in sorted((r for r in rows if not r[4]), key=lambda r: (r[3], r[0])):
        others = [a for a in active if a[2] != r[2] and a[1] == r[1]]
        if others:
            out[r[0]] = max(others, key=lambda a: (not a[4], a[3], a[0]))[0]
        else:
            active.append(r)
            out[r[0]] = None
    return out


def test_append_only_corroborates_the_latest_of_another_origin(spark):
    from factloom.operators.resolution import append_only

    rng = random.Random(3)
    for case in range(4):
        stored = [(f"s{i}", "x", rng.choice("ab"[: 1 + case % 2]), i, True, rng.choice(["active", "active", "superseded"])) for i in range(case)]
        new = [(f"n{i:02d}", rng.choice("xy"), rng.choice("aab"), 10 + i // 2, False, None) for i in range(20)]
        made = spark.createDataFrame([(*r, "e", "p", None, None) for r in stored + new], "fact_id string, object string, origin_key string, recorded_at int, stored boolean, status string, entity_id string, predicate string, user_id string, derived_version string")
        got = {r.fact_id: r.corroborates for r in append_only(made).collect()}
        assert got == append_by_hand(stored + new), case
    three = spark.createDataFrame([("f1", "A", 1), ("f2", "A", 2), ("f3", "B", 3)], "fact_id string, origin_key string, recorded_at int").selectExpr("*", "'x' AS object", "'e' AS entity_id", "'p' AS predicate", "NULL AS user_id", "NULL AS derived_version")
    assert {r.fact_id: r.corroborates for r in append_only(three).collect()} == {"f1": None, "f2": None, "f3": "f2"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        after = [0]
        for i, y in enumerate(b):
            after.append(row[i] + 1 if x == y else max(row[i + 1], after[-1]))
        row = after
    return row[-1]


def test_rouge_l_by_brute_force(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("uvw") for _ in range(rng.randint(0, 30))], [rng.choice("uvw") for _ in range(rng.randint(0, 30))]) for _ in range(60)]
    rows = spark.createDataFrame([(str(i), " ".join(a), " ".join(e)) for i, (a, e) in enumerate(pairs)], "id string, answer string, expected string")
    for r in evaluation.token_overlap(rows).collect():
        a, e = pairs[int(r.id)]
        assert math.isclose(r.rouge_l, 1.0 if not a and not e else 2 * lcs(a, e) / (len(a) + len(e)))


def test_entities_match_within_their_type_only(spark):
    from factloom.operators.search import match_entities

    entities = spark.createDataFrame([(i, "other", f"n{i}", [1.0, i / 1000]) for i in range(40)] + [(99, "mine", "z", [1.0, 0.2])], "entity_id int, type string, canonical_name string, embedding array<double>")
    names = spark.createDataFrame([(1, "mine", "unknown", [1.0, 0.0]), (2, "mine", " Z ", [0.0, 1.0])], "name_id int, type string, name string, q array<double>")
    assert {(r.name_id, r.entity_id, r.how) for r in match_entities(names, entities).collect()} == {(1, 99, "vector"), (2, 99, "name")}


def test_queries_without_new_names_keep_their_text(spark):
    from factloom.operators.retrieval import expansion_terms

    queries = spark.createDataFrame([(1, "about Ann"), (2, "about Bob")], "query_id int, text string")
    hits = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (2, "b", 1.0)], "query_id int, entity_id string, rank_score double")
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "entity_id string, canonical_name string")
    assert {r.query_id: r.text for r in expansion_terms(hits, queries, names).collect()} == {1: "about Ann Bob", 2: "about Bob"}


def test_masks_leave_dates_alone(spark):
    said = {"mail a.b@c.org now": "mail [EMAIL] now", "call +1 (706) 555-3138": "call [PHONE]", "2019-2023": "2019-2023", "2023-05-07 12:34:56": "2023-05-07 12:34:56", "id 4785380592391139": "id [PHONE]", "n 12345678": "n 12345678"}
    rows = spark.createDataFrame(list(said.items()) + [(None, None)], "text string, want string")
    assert text.redact_pii(rows).where("NOT text <=> want").count() == 0


def test_grounding_needs_whole_words(spark):
    claims = spark.createDataFrame([(1, 1, "Bob", "act"), (2, 1, "Bob", "active"), (3, 1, "Eve", "active")], "claim_id int, doc_id int, name string, value string")
    docs = spark.createDataFrame([(1, "Bob is active.")], "doc_id int, text string")
    assert {r.claim_id: r.reason for r in text.check_grounding(claims, docs).collect()} == {1: "ungrounded_value", 2: None, 3: "ungrounded_entity"}


def test_chunks(spark):
    made = "".join(f"Sentence number {i}. " for i in range(200))
    docs = spark.createDataFrame([(1, made), (2, "x" * 100), (3, ""), (4, None), (5, "y" * 333)], "doc_id int, text string")
    chunks = text.chunk_documents(docs, 80, 100, 10).collect()
    one = sorted((c for c in chunks if c.doc_id == 1), key=lambda c: c.seq)
    assert all(made[c.char_start : c.char_end] == c.text for c in one) and one[-1].char_end == len(made)
    assert all(b.char_start == a.char_end - 10 for a, b in zip(one, one[1:]))  # noqa: B905
    assert [c.text for c in chunks if c.doc_id == 2] == ["x" * 100] and not [c for c in chunks if c.doc_id in (3, 4)]


def test_hmac_is_the_standard_one(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(maintenance.hmac_sha256("key", F.lit("message")).alias("h")).first().h
    assert got == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()


def test_bootstrap_covers_the_mean(spark):
    values = spark.range(400).selectExpr("id", "CAST(id % 10 AS DOUBLE) AS value")
    ci = evaluation.bootstrap_ci(values, 200).first()
    assert ci.low < 4.5 < ci.high and ci.high - ci.low < 1.0 and ci["mean"] == 4.5


def test_bootstrap_rounds_are_poisson_resamples(spark):
    import numpy as np

    w = evaluation.poisson_weights(np.arange(2000), 500, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and w.max() < 12
    rows = [(i, float(i % 7)) for i in range(50)] + [(99, None)]
    got = {r["round"]: (r.weight, r.total) for r in evaluation.bootstrap_sums(spark.createDataFrame(rows, "id int, value double").repartition(3), 30, 4).collect()}
    keys = np.array([r.k for r in spark.createDataFrame(rows[:50], "id int, value double").selectExpr("xxhash64(id) AS k").collect()])
    w = evaluation.poisson_weights(keys, 30, 4)
    want = {k + 1: (w[:, k].sum(), sum(w[i, k] * (i % 7) for i in range(50))) for k in range(30)}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k], strict=True))
    means = np.array([t / n for n, t in got.values()])
    assert abs(means.std() - np.std([i % 7 for i in range(50)]) / 50**0.5) < 0.12
    assert tuple(evaluation.bootstrap_ci(spark.createDataFrame([], "id int, value double")).first()) == (None, None, None)
    assert "Generate" not in evaluation.bootstrap_ci(spark.createDataFrame(rows, "id int, value double"))._jdf.queryExecution().executedPlan().toString()


def test_an_empty_keep_set_is_refused(spark):
    with pytest.raises(ValueError, match="empty keep set"):
        maintenance.gc_worlds(spark.createDataFrame([fact("a", dt(2024, 1, 1))], FACT).withColumn("derived_version", F.lit("v")), spark.createDataFrame([], "version string"))


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"entities": [{"id": "e1", "facts": [{"predicate": "p", "object": "o", "validFrom": "2024-01-01T00:00:00Z", "confidence": 0.5}]}]}')
    assert [tuple(r)[:3] for r in readers.load_directory(spark, str(tmp_path / "d.json")).collect()] == [("e1", "p", "o")]
    (tmp_path / "c.json").write_text('{"speaker_a": "A", "session_1": [{"dia_id": "D1:1", "speaker": "A", "text": "hi"}, {"dia_id": "D1:2", "speaker": "B", "text": "ho"}], "session_1_date_time": "May 1"}')
    assert [(r.session, r.turn, r.text, r.date) for r in readers.load_conversations(spark, str(tmp_path / "c.json")).orderBy("turn").collect()] == [(1, 0, "hi", "May 1"), (1, 1, "ho", "May 1")]
    changes = spark.createDataFrame([("s", "r", 1), ("s", "r", 1), ("s", "r", 2)], "source string, record_id string, version long")
    for _ in range(2):
        readers.write_audit(changes, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch, rows):

    vectors = spark.range(60).selectExpr("id AS fact_id", "array(sin(id), cos(id), id % 3 + 0.5D) AS embedding")
    queries = vectors.selectExpr("fact_id AS query_id", "embedding AS q")
    whole = rows(similarity.exact_knn(queries, vectors, 4))
    monkeypatch.setattr(neighbours, "BROADCAST", 20)
    monkeypatch.setattr(neighbours, "BLOCK", 90)
    assert rows(similarity.exact_knn(queries, vectors, 4)) == whole


def test_retraction_goes_down_and_brings_back(spark):
    day = lambda n: dt(2024, 1, n)
    rows = [
        fact("root", day(1), day(9)), fact("open", day(1)), fact("old", day(1), day(4), status="superseded", superseded_by="root", prior_valid_until=day(20)), fact("child", day(2)), fact("grandchild", day(2), day(30)),
        fact("gone", day(2), retracted_at=day(3), status="retracted"), fact("below", day(2)), fact("older", day(1), day(2), status="superseded", superseded_by="child"), fact("by_gone", day(1), day(2), status="superseded", superseded_by="gone"),
    ]
    links = spark.createDataFrame([("child", "root"), ("grandchild", "child"), ("gone", "root"), ("below", "gone"), ("root", "grandchild")], "fact_id string, parent string")
    from factloom.operators.resolution import retract

    for with_reason in (False, True):
        facts = spark.createDataFrame(rows, FACT)
        if with_reason:
            facts = facts.withColumn("retraction_reason", F.when(F.col("fact_id") == "old", "withdrawn"))
        ids = spark.createDataFrame([("root",), ("open",), ("gone",), ("root",)], "fact_id string")
        got = {r.fact_id: r for r in retract(facts, ids, links, F.lit(day(15)), "wrong").collect()}
        assert len(got) == len(rows)
        state = {i: (r.status, r.retracted_at, r.valid_until, r.superseded_by) for i, r in got.items()}
        assert state["root"] == ("retracted", day(15), day(9), None) and state["open"] == ("retracted", day(15), day(15), None)
        assert state["child"] == ("retracted", day(15), day(15), None) and state["grandchild"] == ("retracted", day(15), day(15), None)
        assert state["gone"] == ("retracted", day(3), None, None) and state["below"] == ("active", None, None, None)
        assert state["older"][0] == "superseded" and state["by_gone"][0] == "superseded"
        assert state["old"] == (("superseded", None, day(4), "root") if with_reason else ("active", None, day(20), None))
        assert (got["root"].retraction_reason, got["child"].retraction_reason) == ("wrong", "parent retracted: wrong")


def test_retraction_of_odd_rows_meets_whole_facts_once(spark):
    """Ids that are missing or repeated with other successors; facts are not dealt out by a successor that most of them lack."""
    from factloom.operators.resolution import retract

    day = lambda n: dt(2024, 1, n)
    old = lambda i, by, n: fact(i, day(1), day(4), status="superseded", superseded_by=by, prior_valid_until=day(n))
    rows = [fact("root", day(1)), fact("kept", day(1)), old(None, "root", 20), old(None, "kept", 21), old("twice", "root", 22), old("twice", "kept", 23), old("twice", "other", 24), fact("other", day(2)), old("root", "other", 25)]
    ids = spark.createDataFrame([("root",), ("other",), (None,), ("missing",)], "fact_id string")
    links = spark.createDataFrame([("kept", "missing")], "fact_id string, parent string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = retract(spark.createDataFrame(rows, FACT), ids, links, F.lit(day(15)), "wrong")
        got = sorted(((r.fact_id or "", r.status, r.valid_until, r.superseded_by) for r in out.collect()), key=str)
        plan = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    back = [("", "active", day(20), None), ("twice", "active", day(22), None), ("twice", "active", day(24), None)]
    same = [("", "superseded", day(4), "kept"), ("twice", "superseded", day(4), "kept"), ("kept", "active", None, None)]
    gone = [("root", "retracted", day(15), None), ("root", "retracted", day(4), "other"), ("other", "retracted", day(15), None)]
    assert got == sorted(back + same + gone, key=str)
    assert plan.count("LeftOuter") == 1


def test_spans_in_scripts_with_and_without_blanks(spark):
    cases = [
        ("私は東京大学に行く", "東京", True), ("私は大学", "東京", False), ("very active now", "act", False), ("an act, now", "act", True), ("active act", "ACT", True), ("Москва-река", "москв", False),
        ("Москва-река", "Москва", True), ("uses c++ daily", "C++", True), ("a \\E b", "\\E", True), ("a\u00a0 b", "a b", True), ("x1y", "1", True), ("text", "", False), ("text", None, False), (None, "x", False), ("étéx", "été", False),
    ]
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s string")
    found = rows.select("i", text.holds_span(text.normal_span(F.col("t")), text.normal_span(F.col("s"))).alias("there"))
    assert {r.i: r.there for r in found.collect()} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_commit_rules_in_order(spark):
    long = "w " * 40 + "end"
    cases = [
        ("Merge branch 'x' into y", "Why: x", None, "merge"), ("chore: x", "words\nGotcha: this", None, "trailer"), ("chore: x", "", "done to avoid harm", "rationale"), ("chore: x", long, None, "body"),
        ("chore: x", "short", None, "routine"), ("feat!: x", "", None, "short"), ("feat(a): x", long, None, "typed_body"), ("x", "Because of it", None, "rationale"), ("because", "", None, "short"),
        ("why: x", None, None, "short"), ("docs: x", None, None, "routine"), ("x", "  BREAKING CHANGE: api", None, "trailer"), ("x", "Why:", None, "short"), (None, None, None, "short"), ("Merge of lists", "", None, "short"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, subject string, body string, pr_body string, want string")
    assert [tuple(r) for r in text.classify_commits(rows).where("rule <> want").select("i", "rule").collect()] == []


def test_mentions_are_dropped_as_by_a_fold_in_order(spark):
    rng = random.Random(11)
    lines = [(rng.choice(["hot", "hot", "hot", "q"]), rng.randint(0, 60), "[d] me: " * rng.randint(0, 1) + " ".join(rng.choices("abcdefghij"[: rng.choice([5, 10])], k=rng.randint(0, 9)))) for _ in range(220)] + [("q", 1, None)]
    want = []
    for q in ("hot", "q"):
        kept = []
        for seq, line in sorted(((s, t) for i, s, t in lines if i == q), key=lambda x: (x[0], x[1] is not None, x[1])):
            words = set((line or "").removeprefix("[d] me: ").split())
            if any(min(len(words), len(k)) >= 3 and len(words & k) >= 0.7 * min(len(words), len(k)) for k, _ in kept):
                continue
            kept.append((words, (q, seq, line)))
        want += [row for _, row in kept]
    for parts in (1, 3):
        got = text.dedupe_mentions(spark.createDataFrame(lines, "query_id string, seq int, text string").repartition(parts))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_words_of_mentions_meet_without_the_texts(spark, monkeypatch):
    """What is shuffled for each word of a line are numbers and the word, not the whole line."""
    plans, kept = [], text.written
    monkeypatch.setattr(text, "written", lambda df: (plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())), kept(df))[1])
    lines = [("q", 2, "b c d e"), ("q", 1, "a b c d"), ("q", 1, "a b c d x"), ("r", 1, "a b c d"), ("q", 3, None)]
    got = text.dedupe_mentions(spark.createDataFrame(lines, "query_id string, seq int, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [lines[1], lines[3], lines[4]]))
    plan = next(p for columns, p in plans if columns == ["early", "late"])
    assert "text" not in plan


def test_names_become_prefixes_after_equal_ones_are_cut(spark, rows):
    """Of a thousand equal names only the k best are made prefixes, and others keep their places."""
    from factloom.operators import text

    names = [(i, "Abc" if i % 2 else "abC", i % 7) for i in range(1000)] + [(2000, "abd", 100), (2001, "a", 1), (2002, None, 1)]
    df = spark.createDataFrame(names, "entity_id int, name string, weight int")
    got = rows(text.prefix_table(df, k=3).select("prefix", "rank", "entity_id"))
    low = sorted(((n or "").lower(), -w, n, i) for i, n, w in names if n and len(n) >= 2)
    want = [(p, r, i) for p in ("ab", "abc", "abd") for r, (_, _, i) in enumerate(sorted(x[1:] for x in low if x[0].startswith(p))[:3], 1)]
    assert got == sorted(want, key=str)
    text_plan = text.prefix_table(df, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert text_plan.index("Generate") < text_plan.rindex("Window")  # plans are read from the end: a window comes before the prefixes


def test_resolution_reads_its_facts_once(spark):
    """What makes the facts is done once, not by each part of the resolution."""
    from pyspark.sql import functions as F

    from factloom.operators import resolution

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double", useArrow=False)
    def counted(x):
        seen.add(1)
        return x

    facts = spark.sql("""SELECT concat('f', id) AS fact_id, concat('e', id % 3) AS entity_id, 'p' AS predicate, CAST(NULL AS STRING) AS user_id, CAST(NULL AS STRING) AS derived_version,
        concat('o', id % 2) AS object, CASE id % 3 WHEN 0 THEN 'bitemporal' ELSE 'single_active' END AS semantics, 0.5D AS confidence, 0.5D AS declared_trust, 0.5D AS learned_trust, 0.0D AS authority,
        concat('g', id % 5) AS origin_key, array(1.0D) AS embedding, timestamp_seconds(id * 1000) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until, timestamp_seconds(id * 1000) AS recorded_at FROM range(30)""")
    out = resolution.resolve_facts(facts.withColumn("confidence", counted("confidence")), "1999-06-01")
    assert out.count() == 30 and len(out.collect()) == 30 and seen.value == 30
