"""Recall of the approximate neighbours against the exact ones."""

import random

import numpy as np
import pytest

from factloom.operators import inverted, similarity


def both(spark, queries, vectors, k):
    q = spark.createDataFrame(queries, "query_id long, q array<float>")
    v = spark.createDataFrame(vectors, "fact_id long, embedding array<float>")
    found, exact = ({(r.query_id, r.fact_id) for r in f(q, v, k).collect()} for f in (inverted.approx_knn, similarity.exact_knn))
    return found, exact


def test_recall_with_few_near_neighbours(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(600)]
    queries = [(i, [x + rng.gauss(0, 0.1) for x in v]) for i, v in vectors[:40]]
    found, exact = both(spark, queries, vectors, 10)
    print("recall", len(found & exact) / len(exact))
    assert len(found) == len(exact) == 400 and len(found & exact) >= 0.9 * len(exact)


def test_far_neighbours_fill_the_list(spark):
    vectors = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0])]
    found, exact = both(spark, [(7, [1.0, 0.1, 0.0])], vectors, 4)
    assert found == exact and len(found) == 4


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_and_probes_follow_the_data(spark, spread, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 24 * 300)  # a cell is more than one block
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 24))
    vectors = [(i, (centres[0 if i % 3 else i % 20] + spread * rng.normal(size=24)).tolist()) for i in range(3000)]
    queries = [(i, v) for i, v in vectors if i % 50 == 0]
    found, exact = both(spark, queries, vectors, 10)
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)
    v = spark.createDataFrame(vectors, "fact_id long, embedding array<float>")
    cells = inverted.fit_cells(v, 10)
    assert cells.probes < len(cells.centres) / 2 or spread == 1.0


def test_nothing_near_or_nothing_at_all(spark):
    found, exact = both(spark, [(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], [(1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0])], 2)
    assert found == exact
    found, exact = both(spark, [(1, [0.0, 1.0])], [(1, [0.0, 1.0])], 2)
    assert found == exact == {(1, 1)}
    v = spark.createDataFrame([], "fact_id long, embedding array<float>")
    assert inverted.approx_knn(v.withColumnsRenamed({"fact_id": "query_id", "embedding": "q"}), v, 3).count() == 0


def test_the_k_best_of_a_part_and_of_all_parts_agree(spark, monkeypatch):
    """Parts with many equal similarities, fewer columns than k, and groups; ties go to smaller ids."""
    from factloom.operators import neighbours

    monkeypatch.setattr(neighbours, "AT_ONCE", 30)
    held = [(i, i % 2, [float(i * 7 % 5), 1.0]) for i in range(60)]
    asked = [(i, i % 2, [float(i), 1.0]) for i in range(6)]
    vectors = spark.createDataFrame(held, "fact_id int, g int, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id int, g int, q array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 12)  # noqa: E731, B905
    for k in (1, 4, 100):
        got = sorted((r.query_id, r["rank"], r.fact_id) for r in neighbours.exact_knn(queries, vectors, k, 0.5, by="g").collect())
        want = []
        for q, g, v in asked:
            near = sorted((-cos(v, e), i) for i, h, e in held if h == g and cos(v, e) >= 0.5)[:k]
            want += [(q, n, i) for n, (_, i) in enumerate(near, 1)]
        assert got == want
