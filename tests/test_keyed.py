"""Stored tables that take changes by key."""

import os

from shelfmark.sources import keyed


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_runs" not in d}


def rows(spark, path, schema):
    return {tuple(r) for r in keyed.stored(spark, path, schema).collect()}


def test_changes_by_key(spark, tmp_path):
    at = str(tmp_path / "t")
    first = spark.createDataFrame([(k, "a", f"v{k}") for k in range(40)] + [(None, "a", "null key")], "id long, part string, v string")
    assert rows(spark, at, first.schema) == set()
    assert keyed.apply_changes(at, first, ["id", "part"], "r1", buckets=8)
    assert rows(spark, at, first.schema) == {tuple(r) for r in first.collect()}
    before = files(at)
    change = spark.createDataFrame([(3, "a", "new"), (None, "a", "other"), (3, "b", "added")], first.schema)
    assert keyed.apply_changes(at, change, ["id", "part"], "r2", buckets=8)
    want = {(k, "a", f"v{k}") for k in range(40) if k != 3} | {(3, "a", "new"), (None, "a", "other"), (3, "b", "added")}
    assert rows(spark, at, first.schema) == want
    assert 0 < len(before - files(at)) < len(before)  # untouched buckets keep their files
    now = files(at)
    assert not keyed.apply_changes(at, change.limit(0), ["id", "part"], "r1", buckets=8)
    assert not keyed.apply_changes(at, change, ["id", "part"], "r2", buckets=8)
    assert files(at) == now and rows(spark, at, first.schema) == want


def test_taking_out_the_last_row_of_a_bucket(spark, tmp_path):
    at = str(tmp_path / "t")
    first = spark.createDataFrame([(k, "x") for k in range(4)], "id long, v string")
    keyed.apply_changes(at, first, ["id"], "r1", buckets=64)
    keyed.apply_changes(at, first.where("id < 3"), ["id"], "r2", first.id != 1, buckets=64)
    assert rows(spark, at, first.schema) == {(1, "x"), (3, "x")}


def test_a_run_that_was_lost_is_finished(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    first = spark.createDataFrame([(k, "x") for k in range(20)], "id long, v string")
    keyed.apply_changes(at, first, ["id"], "r1", buckets=4)
    real, calls = keyed._exists, []

    def fail_late(spark_, path):
        calls.append(path)
        return real(spark_, path)

    monkeypatch.setattr(keyed, "_exists", fail_late)
    change = spark.createDataFrame([(5, "y")], first.schema)
    system = keyed._file_system

    def lost(spark_, path):
        if path.endswith("/done") and len(calls) > 1:
            raise RuntimeError("lost")
        return system(spark_, path)

    monkeypatch.setattr(keyed, "_file_system", lost)
    try:
        keyed.apply_changes(at, change, ["id"], "r2", buckets=4)
        raise AssertionError("not lost")
    except RuntimeError:
        pass
    monkeypatch.setattr(keyed, "_file_system", system)
    assert keyed.apply_changes(at, change, ["id"], "r2", buckets=4)
    assert rows(spark, at, first.schema) == {(k, "y" if k == 5 else "x") for k in range(20)}
