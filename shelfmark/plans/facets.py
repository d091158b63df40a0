"""Filters, semi and anti joins, set operations and pages on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse, filters
from .registry import query, table

_PAGE = """
WITH hit AS (
  SELECT o.* FROM orders o WHERE o_orderstatus = 'O'
    AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'A')
    AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R'))
SELECT o_orderkey, lower(o_orderpriority) AS label, (SELECT count(*) FROM hit) AS total,
  (SELECT count(*) FROM hit) > 48 AS has_more
FROM hit ORDER BY lower(o_orderpriority) NULLS LAST, o_orderkey LIMIT 48"""


@query(_PAGE)
def faceted_browse_page(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    items = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.lower("o_orderpriority").alias("label"))
    hit = filters.having(items, lines.where("l_returnflag = 'A'"), "o_orderkey", "l_orderkey")
    hit = filters.lacking(hit, lines.where("l_returnflag = 'R'"), "o_orderkey", "l_orderkey")
    return browse.Window().page(hit, browse.order("name", "o_orderkey", label="label"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_by_value(spark, d):
    return filters.by_value(table(spark, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("SELECT count(*) FILTER (WHERE c_nationkey IS NULL) AS unset, count(*) AS every FROM customer")
def filter_unset_and_all(spark, d):
    c = table(spark, d, "customer")
    unset = filters.by_value(c, "c_nationkey", filters.NONE).agg(F.count("*").alias("unset"))
    return unset.crossJoin(filters.by_value(c, "c_nationkey", filters.ALL).agg(F.count("*").alias("every")))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)""")
def filter_has_all_tags(spark, d):
    return filters.having_all(table(spark, d, "orders"), table(spark, d, "lineitem"), ["A", "N"], "o_orderkey", "l_returnflag", "l_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def filter_untagged(spark, d):
    return filters.lacking(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_orderkey = o.o_orderkey AND regexp_matches(p_name, '^cold'))""")
def filter_missing_tag_by_pattern(spark, d):
    tags = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return filters.lacking_match(table(spark, d, "orders"), tags, "^cold", "o_orderkey", "p_name", "l_orderkey").select("o_orderkey")


@query("SELECT page_id, url FROM pages WHERE contains(url, 'utm_source')")
def filter_link_contains(spark, d):
    p = table(spark, d, "pages")
    return filters.linking_to(p, p, "utm_source", "page_id", "url").select("page_id", "url")


@query("SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def filter_personal_list(spark, d):
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    return filters.having(table(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def filter_not_in_list(spark, d):
    urgent = table(spark, d, "orders").where(F.col("o_orderpriority").startswith("1"))
    return filters.lacking(table(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer c WHERE c_acctbal > 9000
  OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def filter_or_of_exists(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 400000")
    return filters.meeting_or_having(table(spark, d, "customer"), F.col("c_acctbal") > 9000, large, "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def filter_json_path(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k > 50")


@query("""SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 2))
  OR s_nationkey IS NULL""")
def filter_visible_by_grants(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("object"), F.col("n_regionkey").cast("string").alias("subject"), F.lit("view").alias("permission"))
    subjects = spark.createDataFrame([("1",), ("2",)], "subject string")
    return filters.visible(table(spark, d, "supplier"), nations, subjects, "s_nationkey", ["view"]).select("s_suppkey")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type = 'click'")
def filter_expired(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.where("event_type = 'click'").join(F.broadcast(last)).where(F.col("ts") < F.col("last") - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("""SELECT p_partkey, lower(p_name) AS label FROM part ORDER BY lower(p_name) NULLS LAST, p_partkey LIMIT 48 OFFSET 48""")
def browse_second_window(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("label"))
    return browse.Window.of("48", "48").cut(parts, browse.order("name", "p_partkey", label="label"))


@query("SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || 'seed'), c_custkey LIMIT 48")
def browse_seeded_random(spark, d):
    return browse.Window().cut(table(spark, d, "customer").select("c_custkey"), browse.order("random", "c_custkey", seed="seed"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def browse_keyset_page(spark, d):
    return browse.after(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 1000, 100)


@query("""SELECT * FROM (
  SELECT * FROM (SELECT 'event' AS kind, event_id AS id, ts AS "at" FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS "at" FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20))
ORDER BY "at" DESC NULLS LAST, kind, id LIMIT 20""")
def browse_timeline(spark, d):
    return browse.timeline({"event": (table(spark, d, "events"), "event_id", "ts"), "order": (table(spark, d, "orders"), "o_orderkey", "o_orderdate")})


@query("SELECT p_partkey, length(p_name) AS n FROM part ORDER BY length(p_name) DESC, p_partkey LIMIT 50")
def browse_longest_first(spark, d):
    return table(spark, d, "part").select("p_partkey", F.length("p_name").alias("n")).orderBy(F.desc("n"), "p_partkey").limit(50)


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, d):
    return table(spark, d, "part").select("p_partkey").subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersection(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select("c_nationkey")).distinct()


@query("""WITH ids AS (SELECT unnest([1, 2, 3, 999999999]) AS id)
SELECT count(*) AS asked, count(c_custkey) AS known, count(*) = count(c_custkey) AS complete FROM ids LEFT JOIN customer ON c_custkey = id""")
def set_all_requested_known(spark, d):
    ids = spark.createDataFrame([(1,), (2,), (3,), (999999999,)], "id long")
    joined = ids.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("id"), "left")
    return joined.agg(F.count("*").alias("asked"), F.count("c_custkey").alias("known"), (F.count("*") == F.count("c_custkey")).alias("complete"))


@query("""WITH t AS (SELECT c_nationkey, count(*) AS total FROM customer GROUP BY 1)
SELECT c_nationkey, total, 3 AS page, 2 AS previous, CASE WHEN total > 60 THEN 4 END AS next, CAST(ceil(total / 20) AS BIGINT) AS last FROM t WHERE total > 40""")
def browse_page_links(spark, d):
    """The links of the third page of each nation's customers that has one."""
    window = browse.Window.of(40, 20)
    totals = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("total")).where("total > 40")
    v = totals.withColumn("v", browse.links(window, F.col("total")))
    return v.select("c_nationkey", "total", "v.page", "v.previous", "v.next", "v.last")
