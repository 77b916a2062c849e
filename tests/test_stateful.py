"""Keyed state: what streams give, over many batches and restarts, is what the batch form gives."""

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest

from factloom.operators.resolution import fold_arrivals, resolve_facts
from factloom.streaming import stateful, streams

FACTS = (
    "fact_id string, object string, semantics string, confidence double, declared_trust double, learned_trust double, authority double, origin_key string, "
    "embedding array<double>, valid_from timestamp, valid_until timestamp, recorded_at timestamp, entity_id string, predicate string, user_id string, derived_version string"
)


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def collected(df, path, mode="update"):
    """Run a stream into parquet, a folder a batch."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
    q = q.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).start()
    q.processAllAvailable()
    q.stop()


def test_stream_of_facts_is_the_batch_fold_also_after_a_restart(rocksdb, tmp_path):
    spark, rng = rocksdb, random.Random(3)
    kinds = {"e0": "single_active", "e1": "bitemporal", "e2": "events"}
    rows = []
    for i in range(60):
        e = f"e{i % 3}"
        start = dt(2024, 1, 1) + timedelta(hours=rng.randint(0, 300))
        rows.append((f"f{i:02d}", rng.choice("xyz"), kinds[e], 0.3 + i % 5 / 10, 0.9, 0.5, 0.0, rng.choice(["a", "b", None]), [1.0, float(i % 2)], start, None if i % 4 else start + timedelta(days=30), dt(2024, 3, 1, 0, i), e, "p", None, "v" if i % 6 else None))
    for k in range(6):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], FACTS).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        if k in (2, 5):  # the second time from the checkpoint
            collected(stateful.resolve_stream(streams.read_stream(spark, str(tmp_path / "in"), FACTS, 1), "2024-06-01"), tmp_path)
    got = stateful.latest_revision(spark.read.parquet(str(tmp_path / "out")).drop("batch"))
    want = resolve_facts(spark.createDataFrame(rows, FACTS), "2024-06-01")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_state_holds_open_facts_only():
    from datetime import timezone

    from factloom.operators.resolution import Config

    held, day = [], dt(2024, 1, 1, tzinfo=timezone.utc)
    for k in range(50):
        new = [{"fact_id": f"f{k}-{j}", "object": "xy"[j % 2], "semantics": "single_active", "confidence": 0.5, "declared_trust": 0.5, "learned_trust": 0.5, "authority": 0.0, "origin_key": "a", "embedding": None, "valid_from": day + timedelta(days=k), "valid_until": None, "recorded_at": day + timedelta(days=k)} for j in range(10)]
        assert len(list(fold_arrivals(new, held, day, Config()))) >= 9 and len(held) == 1


CHANGES = "source string, op string, record_id string, row string, version long, at timestamp"


def change(version, hour, source="s", record="r"):
    return (source, "UPDATE", record, f"row {version}", version, dt(2024, 1, 1) + timedelta(hours=hour))


def test_changes_leave_in_version_order_and_once(rocksdb, tmp_path):
    spark = rocksdb
    batches = [
        [change(3, 3), change(1, 1), change(2, 2), change(7, 1, "t")],
        [change(2, 2), change(3, 3)],
        [change(9, 60, "s", "tick")],  # the watermark passes what waits
        [change(4, 70), change(2, 70), change(3, 71)],  # 2 and 3 again, a day later
        [change(9, 60, "s", "tick"), change(10, 200, "s", "tick")],
        [change(11, 400, "s", "tick")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        if k in (2, 5):
            collected(stateful.ordered_changes(streams.read_stream(spark, str(tmp_path / "in"), CHANGES, 1)), tmp_path, "append")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    left = [r.version for r in sorted(got, key=lambda r: (r.batch, r.place)) if r.source == "s"]
    assert left == sorted(set(left)) and left[:3] == [1, 2, 3] and 9 in left and [r.version for r in got if r.source == "t"] == [7]
