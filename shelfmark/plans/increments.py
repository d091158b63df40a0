"""Incremental runs on the driver's tables, as batches with SQL and as one stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import detectors
from ..sources import keyed, records
from ..staging import shared_dir
from ..streaming import incremental
from .registry import query, table


@query("""WITH m AS (SELECT event_type, max(ts) - INTERVAL 3 DAY AS mark FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT event_id FROM events LEFT JOIN m USING (event_type) WHERE mark IS NULL OR ts >= mark""")
def rows_since_mark(spark, d):
    e = table(spark, d, "events")
    marks = e.where("event_type <> 'view'").groupBy("event_type").agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("mark"))
    return incremental.since(e, marks, ["event_type"], "ts").select("event_id")


@query("SELECT event_type, max(ts) AS mark FROM events GROUP BY 1")
def next_marks(spark, d):
    e = table(spark, d, "events")
    return incremental.next_marks(e, e.where("event_id < 100").select("event_type", F.col("ts").alias("mark")), ["event_type"], "ts")


@query("""SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS NULL OR ts > before + INTERVAL 15 MINUTE""")
def burst_starts(spark, d):
    return incremental.starts(table(spark, d, "events"), ["user_id"], "ts", "15 MINUTES", "event_id").select("event_id")


_POSTS = """WITH RECURSIVE p AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1 UNION ALL SELECT p.user_id, min(e.ts) FROM p JOIN events e ON e.user_id = p.user_id AND e.ts > p.ts + INTERVAL 12 HOUR GROUP BY p.user_id)
SELECT min(event_id) AS event_id FROM p JOIN events USING (user_id, ts) GROUP BY user_id, ts"""


@query(_POSTS)
def suppressed_posts(spark, d):
    """Events that are posted, each later than half a day after the user's last post."""
    return incremental.posts(table(spark, d, "events"), ["user_id"], "ts", "12 HOURS", "event_id").select("event_id")


#: Where a stream finds the events: Spark takes a single file by a pattern only, which matches a folder of files as well.
_EVENTS = "{}/[e]vents.parquet"


@query(_POSTS)
def streamed_posts(spark, d):
    """The same on a stream, with the last post as the state of a user. What is there is one batch, so that no file's events come late."""
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = incremental.file_stream(spark, _EVENTS.format(d), table(spark, d, "events").schema, files_per_batch=None).withColumn("ts", F.col("ts").cast("timestamp"))
    posts = incremental.posts(events.withWatermark("ts", "1 day"), ["user_id"], "ts", "12 HOURS", "event_id")
    incremental.apply_once(posts, lambda b: b, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{at}/out").select("event_id")


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS closed, false AS ok, CAST(NULL AS BIGINT) AS event_id FROM events GROUP BY 1
 UNION ALL SELECT user_id, i, CASE WHEN event_type = 'purchase' THEN NULL WHEN ok THEN ts ELSE closed END, ok, event_id FROM (
  SELECT e.*, closed, event_type <> 'purchase' AND (closed IS NULL OR ts >= closed + INTERVAL 3 DAY) AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id FROM r WHERE ok""")
def admitted_jobs(spark, d):
    """Events as requests that lock their user until a purchase, three days at most."""
    events = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "purchase", "done").otherwise("request"))
    return incremental.admitted(events, ["user_id"], "ts", "kind", "3 DAYS", "event_id").select("event_id")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, k""")
def bursts(spark, d):
    return incremental.bursts(table(spark, d, "events").select("user_id", "ts"), ["user_id"], "ts", "6 hours")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 15 DAY")
def retention_sweep(spark, d):
    return table(spark, d, "events").where(incremental.expired(F.col("ts"), F.expr("timestamp_ntz'2024-02-01'"), "15 DAYS")).select("event_id")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def streamed_debounce(spark, d):
    """A file stream, one row per user and type, applied once per batch and read back."""
    at = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = incremental.file_stream(spark, _EVENTS.format(d), schema).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    once = incremental.debounced(stream, ["user_id", "event_type"], "ts", "10000 days")
    incremental.apply_once(once, lambda b: b, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("""WITH l AS (SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS tags, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS files FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderpriority AS name, tags, files FROM orders LEFT JOIN l ON id = o_orderkey""")
def export_packages(spark, d):
    """Data packages of all orders, read back: names, tags and files."""
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("license"))
    lines = table(spark, d, "lineitem")
    tags = lines.select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("tag"))
    files = lines.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("string").alias("filename"))
    p = F.from_json("json", records.PACKAGE)
    read = records.export_packages(items, tags, files).select("id", p.alias("p"))
    return read.select("id", F.col("p.title").alias("name"), F.array_join("p.keywords", ",").alias("tags"), F.array_join(F.transform("p.resources", lambda r: r["path"]), ",").alias("files"))


@query("""WITH a AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 1000), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal BETWEEN 0 AND 2000)
SELECT id, CASE WHEN id % 3 = 0 AND id IN (SELECT id FROM a) THEN 'resolving' ELSE 'detected' END AS state, false AS ignored FROM b""")
def stored_problems(spark, d):
    """Problems in a stored table: detected, some of them taken up and ignored, then detected anew, twice as one run."""
    at = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    first = c.where("c_acctbal < 1000").select("id", F.lit("detected").alias("state"), F.lit(False).alias("ignored"))
    keyed.apply_changes(at, first, ["id"], "first", buckets=8)
    taken = first.where("id % 3 = 0").select("id", F.lit("resolving").alias("state"), F.lit(True).alias("ignored"))
    keyed.apply_changes(at, taken, ["id"], "taken", buckets=8)
    for _ in range(2):
        now = c.where("c_acctbal between 0 and 2000").select("id", F.lit("detected").alias("state"), F.lit(False).alias("ignored"))
        old = keyed.stored(spark, at, now.schema)
        cleared = old.join(now.select("id"), "id", "left_anti").withColumn("state", F.lit("gone"))
        keyed.apply_changes(at, detectors.update(old, now, ["id"]).drop("known").unionByName(cleared), ["id"], "second", F.col("state") == "gone", buckets=8)
    return keyed.stored(spark, at, first.schema)


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 3000 AS BIGINT) AS page FROM events")
def resumed_pages(spark, d):
    """Events in pages by their keys: a run of one page, then runs that go on from there until one finds nothing more."""
    at = f"{shared_dir(spark)}/pages/{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id")
    pages = 1
    while incremental.cursor_pages(events, "event_id", 3_000, lambda page: page, at, pages=pages):
        pages = None
    return spark.read.parquet(f"{at}/rows").select("event_id", F.col("page").cast("long").alias("page"))
