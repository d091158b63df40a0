"""Runs that are stopped and go on: cursor pages, and posts on a stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import registry
from shelfmark.streaming import incremental


def kept(spark, at):
    return [(r.page, r.id) for r in spark.read.parquet(f"{at}/rows").orderBy("id").collect()]


def test_pages_go_on_where_a_run_was_lost(spark, tmp_path):
    at = str(tmp_path / "p")
    rows = spark.range(0, 25).select("id")
    assert incremental.cursor_pages(rows, "id", 10, lambda p: p, at, pages=1) == 1

    def lost(page):
        page.write.mode("overwrite").parquet(f"{at}/rows/page=1")  # the page is there, its mark is not
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.cursor_pages(rows, "id", 10, lost, at)
    assert incremental.cursor_pages(rows, "id", 10, lambda p: p, at) == 2
    assert kept(spark, at) == [(k // 10, k) for k in range(25)]
    more = rows.union(spark.range(30, 32))
    assert incremental.cursor_pages(more, "id", 10, lambda p: p, at) == 1
    assert kept(spark, at)[-2:] == [(3, 30), (3, 31)]
    assert incremental.cursor_pages(more.limit(0), "id", 10, lambda p: p, at) == 0
    later = F.current_timestamp() + F.expr("INTERVAL 40 DAYS")
    assert incremental.cursor_pages(rows, "id", 100, lambda p: p, at, at=later, pages=1) == 1
    assert (0, 24) in kept(spark, at)


def test_posts_on_a_stream_keep_their_state(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    schema = "id long, who string, ts timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(minutes):
        spark.createDataFrame([(m, "a", start + datetime.timedelta(minutes=m)) for m in minutes], schema).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "1 hour")
        posts = incremental.posts(events, ["who"], "ts", "15 MINUTES", "id")
        posts.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run([0, 10, 20])
    run([30, 40, 50])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 20, 40]


def test_posts_on_a_stream_order_what_comes_in_parts(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(m, "a", start + datetime.timedelta(minutes=m)) for m in (50, 40, 30, 20, 10, 0)]
    spark.createDataFrame(rows, "id long, who string, ts timestamp").coalesce(1).write.parquet(source)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        events = incremental.file_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=None).withWatermark("ts", "1 hour")
        incremental.apply_once(incremental.posts(events, ["who"], "ts", "15 MINUTES", "id"), lambda b: b, out, state).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 20, 40]


@pytest.mark.parametrize("name", ["streamed_posts", "streamed_debounce"])
def test_streamed_tables_may_be_folders(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    run = lambda d: sorted(map(tuple, registry.QUERIES[name](spark, d).collect()))
    assert run(str(tmp_path)) == run("/root/testdata/sf0.001")


def test_many_pages_take_few_jobs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "LAP", 4)
    steps, at = [], str(tmp_path / "p")
    rows = spark.range(0, 95).repartition(5).select("id")
    assert incremental.cursor_pages(rows, "id", 10, lambda p: steps.append(p) or p, at) == 10
    assert len(steps) == 3 and kept(spark, at) == [(k // 10, k) for k in range(95)]
