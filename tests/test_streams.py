"""Streams give what the batch forms give on the same rows."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from factloom.streaming import streams


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_sessions(spark, tmp_path):
    times = [(0, 0), (1, 0), (3, 0), (9, 0)]
    turns = spark.createDataFrame([("c", dt(2024, 1, 1, h, m)) for h, m in times] + [("z", dt(2024, 1, 3))], "conversation_id string, occurred_at timestamp")
    turns.write.parquet(str(tmp_path / "t"))
    out = drained(streams.session_stream(streams.read_stream(spark, str(tmp_path / "t"), turns.schema)), "sessions")
    assert sorted(r.n for r in out.collect() if r.conversation_id == "c") == [1, 1, 2]


def test_audit_takes_each_change_once(spark, tmp_path):
    rows = [("s", dt(2024, 1, 1), 1, '{"id": "a", "status": "active", "object": "private"}', None, None, None)] * 2 + [("s", dt(2024, 1, 1), 2, None, None, None, '{"id": "a"}')]
    df = spark.createDataFrame(rows, "source string, at timestamp, version long, `create` string, `update` string, current string, `delete` string")
    df.write.parquet(str(tmp_path / "c"))
    out = drained(streams.audit_stream(streams.read_stream(spark, str(tmp_path / "c"), df.schema)), "audit").collect()
    assert sorted((r.op, r.record_id, r.version) for r in out) == [("CREATE", "a", 1), ("DELETE", "a", 2)]
    assert not any("private" in (r.row or "") for r in out)


def test_counts(spark, tmp_path):
    df = spark.createDataFrame([("active", 1), ("active", 1), ("active", -1), ("retracted", 1)], "status string, delta int")
    df.write.parquet(str(tmp_path / "d"))
    out = drained(streams.stats_stream(streams.read_stream(spark, str(tmp_path / "d"), df.schema)), "counts", "complete")
    assert {r.status: r.n for r in out.collect()} == {"active": 1, "retracted": 1}


def test_live_facts_pass_scopes_and_policies(spark, tmp_path):
    df = spark.createDataFrame([("f1", "p", dt(2024, 1, 1)), ("f1", "p", dt(2024, 1, 1)), ("f2", "secret", dt(2024, 1, 1)), ("f3", "bad", dt(2024, 1, 1))], "fact_id string, predicate string, recorded_at timestamp")
    df.write.parquet(str(tmp_path / "f"))
    registry = spark.createDataFrame([("secret", "pii:read"), ("p", None)], "predicate string, requires_scope string")
    sets = [{"name": "s", "mode": "enforce", "default": "allow", "rules": [{"id": "r", "effect": "deny", "when": [("predicate", "eq", "bad")]}]}]
    out = drained(streams.live_facts(streams.read_stream(spark, str(tmp_path / "f"), df.schema), registry, sets, []), "live")
    assert [r.fact_id for r in out.collect()] == ["f1"]


def test_stale_marks_follow_transitions(spark, tmp_path):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "fact_id string, parent string")
    df = spark.createDataFrame([("a", "superseded", None), ("y", "active", None)], "fact_id string, status string, derived_version string")
    df.write.parquet(str(tmp_path / "in"))
    q = streams.read_stream(spark, str(tmp_path / "in"), df.schema).writeStream.foreachBatch(streams.stale_batches(lambda: links, str(tmp_path / "out"))).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.fact_id for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("fact_id")).collect()) == ["b", "c"]
