"""Slots of one active fact: runs followed side by side give what one fold gives."""

import random
from datetime import datetime as dt
from datetime import timedelta, timezone

import pytest

from factloom.operators import resolution, slots
from factloom.operators.resolution import Config, fold_slot, resolve_facts
from factloom.operators.slots import Fact

DAY0, NOW = dt(2024, 1, 1, tzinfo=timezone.utc), dt(2024, 6, 1, tzinfo=timezone.utc)
OUT = [c.split()[0] for c in resolution.OUT.split(", ")]
SCHEMA = (
    "fact_id string, object string, semantics string, confidence double, declared_trust double, learned_trust double, authority double, origin_key string, "
    "embedding array<double>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, entity_id string, predicate string, user_id string, derived_version string, stored boolean, status string"
)


def arrivals(rng, n, prefix="f"):
    late, objects, origins = rng.choice([1, 5, 30]), "abcd"[: rng.randint(1, 4)], [None, "x", "y", "z"][: rng.randint(1, 4)]
    out = []
    for i in range(n):
        start = DAY0 + timedelta(days=max(0, i - rng.randint(0, late)))
        end = None if rng.random() < 0.5 else start + timedelta(days=5)
        out.append(Fact(f"{prefix}{i:03d}", rng.choice(objects), rng.choice(origins), start, end, DAY0 + timedelta(days=i), rng.random(), rng.random(), rng.random(), rng.random()))
    if rng.random() < 0.4:
        out[0] = out[0]._replace(stored=True, status=rng.choice(["active", "competing"]))
    return out


def folded(facts, cfg):
    rows = (f._asdict() | {"semantics": "single_active", "embedding": None} for f in facts)
    return sorted((tuple(r[c] for c in OUT) for r in fold_slot(rows, NOW, cfg)), key=str)


def test_runs_compose_to_the_fold():
    rng = random.Random(7)
    carried = lambda f: {c: getattr(f, c) for c in slots.CARRIED}
    for _ in range(1500):
        facts, cfg = arrivals(rng, rng.randint(1, 30)), Config(clamp_end=rng.random() < 0.5)
        cuts = sorted({0, len(facts), *(rng.randint(0, len(facts)) for _ in range(rng.randint(0, 6)))})
        runs = [facts[a:b] for a, b in zip(cuts, cuts[1:])]
        summed, latest = [], None
        for part, run in enumerate(runs):
            fresh, takers = slots.summary(run, latest)
            summed.append({"part": part, "fresh": carried(fresh) if fresh else None, "takers": [{"first": carried(a), "last": carried(b)} for a, b in takers]})
            latest = max([f.valid_from for f in run] + ([latest] if latest else []))
        got = []
        for c, run in zip(slots.composed(summed), runs, strict=True):
            got += slots.follow(run, NOW, cfg, Fact(**c["active"]) if c["active"] else None, tuple(c["closed_by"].values()) if c["closed_by"] else None)
        assert sorted((tuple(r[c] for c in OUT) for r in got), key=str) == folded(facts, cfg)


def test_summaries_stay_small():
    rng = random.Random(8)
    facts = [Fact(f"f{i}", "ab"[i % 500 == 0], str(i % 97), DAY0 + timedelta(minutes=i - rng.randint(0, 100)), None, DAY0, 0.5, 0.5, 0.5) for i in range(20_000)]
    assert len(slots.summary(facts, DAY0 + timedelta(minutes=50))[1]) < 300


@pytest.mark.parametrize("run", [6, 1000])
def test_hot_slots_are_cut_and_others_are_not(spark, run):
    rng = random.Random(9)
    rows, want = [], []
    for e, n in (("hot", 90), ("warm", 20), ("cold", 4), ("one", 1), ("several", 8)):
        facts = arrivals(rng, n, e)
        if e == "several":
            facts[:3] = [f._replace(stored=True, status="active") for f in facts[:3]]
        want += folded(facts, Config())
        rows += [(f.fact_id, f.object, "single_active", f.confidence, f.declared_trust, f.learned_trust, f.authority, f.origin_key, None, f.valid_from, f.valid_until, f.recorded_at, e, "p", None, "v", f.stored, f.status) for f in facts]
    rng.shuffle(rows)
    got = resolve_facts(spark.createDataFrame(rows, SCHEMA), "2024-06-01", Config(), run)
    utc = lambda v: v.astimezone(timezone.utc) if isinstance(v, dt) else v
    assert sorted((tuple(utc(r[c]) for c in OUT) for r in got.collect()), key=str) == sorted(want, key=str)


def test_conflicts_are_told_with_their_opponent(spark):
    day = lambda n: DAY0 + timedelta(days=n)
    base = dict(semantics="single_active", confidence=0.5, declared_trust=0.5, learned_trust=0.5, authority=0.0, embedding=[1.0], valid_until=None, entity_id="e", predicate="p", user_id=None, derived_version="v", stored=False, status=None)
    made = [dict(fact_id="a", object="x", origin_key="o1", valid_from=day(1), recorded_at=day(1)), dict(fact_id="b", object="y", origin_key="o1", valid_from=day(1), recorded_at=day(2)), dict(fact_id="c", object="y", origin_key="o1", valid_from=day(3), recorded_at=day(3))]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    facts = spark.createDataFrame([tuple((base | m)[c] for c in names) for m in made], SCHEMA)
    for semantics in ("single_active", "bitemporal"):
        rows = facts.replace("single_active", semantics, "semantics")
        found = {r.fact_id: r for r in resolution.conflict_details(resolve_facts(rows, "2024-06-01"), rows).collect()}
        assert found["b"].opponent == "a" and (found["b"].object_differs, found["b"].start_differs, found["b"].source_differs, found["b"].predicate_differs) == (True, False, False, False)
        if semantics == "single_active":
            assert found["c"].opponent == "b" and (found["c"].object_differs, found["c"].start_differs) == (False, True)
    told = resolution.explain_conflicts(resolve_facts(facts, "2024-06-01"), facts).collect()
    assert sum(r.n for r in told) == 2 and sum(r.object_differs for r in told) == 1


def test_refreshed_summaries_are_written_back(spark):
    from pyspark.sql import functions as F

    day = lambda n: dt(2024, 1, n)
    columns = "fact_id string, object string, confidence double, valid_from timestamp, valid_until timestamp, superseded_by string, retracted_at timestamp, status string, stale_at timestamp"
    facts = spark.createDataFrame([
        ("s", "old", 0.1, day(1), None, None, None, "active", day(9)), ("t", "old", 0.1, day(1), None, None, None, "active", day(9)), ("u", "other", 0.2, day(2), None, None, None, "active", None),
        ("a", "first", 0.4, day(3), day(4), "b", None, "superseded", None), ("b", "second", 0.6, day(5), None, "missing", None, "active", None), ("c", "third", 0.8, day(4), day(8), None, None, "active", None), ("d", "gone", 0.8, day(4), None, None, day(6), "retracted", None),
    ], columns)
    links = spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "b"), ("t", "d")], "fact_id string, parent string")
    stale = facts.where("stale_at IS NOT NULL")
    made = resolution.refresh_summaries(stale, links, facts)
    got = {r.fact_id: r for r in resolution.apply_refresh(facts, made, F.lit(day(20))).collect()}
    s, t = got["s"], got["t"]
    assert (s.object, round(s.confidence, 9), s.valid_from, s.valid_until, s.stale_at, s.status) == ("third; second; second", round(2 / 3, 9), day(4), day(5), None, "active")
    assert (t.object, t.status, t.retracted_at, t.stale_at) == ("old", "retracted", day(20), None) and got["u"].object == "other"
    assert [r.derived_from for r in made.where("n > 0").collect()] == [["c", "b", "b"]]
    upper = resolution.refresh_summaries(stale, links, facts, summary=lambda lines: F.upper(F.array_join(lines, "+"))).where("n > 0").first()
    assert upper.text == "THIRD+SECOND+SECOND"
