"""Worlds switch whole: staged rows, revived ones and dropped partitions in one step, or not at all."""

import pytest

from factloom.sources import versions

ROW = "fact_id string, status string, superseded_by string, valid_until int, prior_valid_until int, n int, derived_version string, conversation_id string"
PARTS = ["derived_version", "conversation_id"]


def world(spark, *rows):
    return spark.createDataFrame([(i, s, by, until, prior, 1, v, c) for i, s, by, until, prior, v, c in rows], ROW)


def seen(spark, path, number=None):
    return sorted((r.fact_id, r.status, r.superseded_by, r.valid_until, r.derived_version, r.conversation_id) for r in versions.read_world_version(spark, path, number).collect())


def test_promotion_switches_at_once_or_not_at_all(spark, tmp_path, monkeypatch):
    path, odd = str(tmp_path / "w"), "v:1/x +%=é"
    first = world(spark, ("a", "active", None, None, None, odd, "c1"), ("b", "superseded", "a", 5, 9, odd, "c2"), ("c", "active", None, None, None, odd, "c3"), ("d", "active", None, None, None, "v2", None))
    with pytest.raises(FileNotFoundError):
        versions.read_world_version(spark, path)
    assert versions.promote_world(first, path, PARTS) == 1
    old = sorted((r.fact_id, r.status, r.superseded_by, r.valid_until, r.derived_version, r.conversation_id) for r in first.collect())
    assert seen(spark, path) == old

    again = world(spark, ("a2", "active", None, None, None, odd, "c1"))
    reader = versions.read_world_version(spark, path)
    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            versions.promote_world(again, path, PARTS)
    assert seen(spark, path) == old

    assert versions.promote_world(again, path, PARTS, based_on=1) == 2
    new = sorted([("a2", "active", None, None, odd, "c1"), ("b", "active", None, 9, odd, "c2"), ("c", "active", None, None, odd, "c3"), ("d", "active", None, None, "v2", None)])
    assert seen(spark, path) == new and seen(spark, path, 1) == old
    assert reader.count() == 4 and sorted(r.fact_id for r in reader.collect()) == ["a", "b", "c", "d"]

    with pytest.raises(versions.Conflict):
        versions.promote_world(again, path, PARTS, based_on=1)
    with pytest.raises(versions.Conflict):
        versions._publish(spark, path, 2, {})
    assert seen(spark, path) == new
    assert len(versions.vacuum(spark, path, 1)) == 2 and seen(spark, path) == new  # what the killed promotion wrote; of version 1 two partitions live on
