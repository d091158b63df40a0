"""Counts, sums, tag clouds, tiers and first rows per group on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, merging, naming, ranking
from .registry import query, table


def _money(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query("SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1")
def count_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM part) AS parts""")
def count_scalars(spark, d):
    counts = [table(spark, d, t).agg(F.count("*").alias(n)) for t, n in (("customer", "customers"), ("orders", "orders"), ("part", "parts"))]
    return counts[0].join(counts[1]).join(counts[2])


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def count_with_zeros(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("orders"))


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def sum_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(_money("o_totalprice").alias("total"))


@query("""SELECT coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0) AS total FROM orders WHERE o_orderkey < 0""")
def sum_of_nothing_is_zero(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 0").agg(F.coalesce(_money("o_totalprice"), F.lit(0.0)).alias("total"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent,
  greatest(count(*) - count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS unfinished FROM orders""")
def library_pulse(spark, d):
    count = F.count("*")
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").agg(
        count.alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.greatest(count - done, F.lit(0)).alias("unfinished")
    )


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_digests(spark, d):
    return detectors.repeated(table(spark, d, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


@query("SELECT count(*) AS names FROM (SELECT lower(p_name), p_brand FROM part GROUP BY ALL HAVING count(*) > 1)")
def duplicate_names_count(spark, d):
    parts = table(spark, d, "part").select(F.lower("p_name").alias("name"), "p_brand")
    return detectors.repeated(parts, ["name", "p_brand"]).agg(F.count("*").alias("names"))


@query("""SELECT name, count(*) AS n FROM (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT lower(r_name) FROM region
  UNION ALL SELECT lower(p_brand) FROM part) GROUP BY 1 HAVING count(*) > 1""")
def names_shared_between_tables(spark, d):
    names = [table(spark, d, t).select(F.lower(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_brand"))]
    return detectors.repeated(names[0].union(names[1]).union(names[2]), ["name"])


@query("""SELECT word AS tag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1
HAVING count(*) >= 2 ORDER BY n DESC, tag""")
def tag_cloud(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("tag"))
    return words.groupBy("tag").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "tag")


@query("""WITH t AS (SELECT p_partkey, p_type || ':' || p_brand AS tag FROM part)
SELECT split_part(tag, ':', 1) AS tier, count(DISTINCT p_partkey) AS items, (SELECT count(*) FROM part) - count(DISTINCT p_partkey) AS unset FROM t GROUP BY 1""")
def key_tiers(spark, d):
    parts = table(spark, d, "part")
    tiers = parts.select("p_partkey", F.substring_index(F.concat("p_type", F.lit(":"), "p_brand"), ":", 1).alias("tier"))
    grouped = tiers.groupBy("tier").agg(F.count_distinct("p_partkey").alias("items"))
    return grouped.join(F.broadcast(parts.agg(F.count("*").alias("every")))).select("tier", "items", (F.col("every") - F.col("items")).alias("unset"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds FROM part GROUP BY 1")
def distinct_kinds(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds"))


@query("SELECT l_orderkey, min(l_quantity) AS lo, max(l_quantity) AS hi, max(l_quantity) - min(l_quantity) AS extent FROM lineitem GROUP BY 1")
def bounds_per_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), (F.max("l_quantity") - F.min("l_quantity")).alias("extent"))


@query("""SELECT o_custkey, o_totalprice, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def best_by_struct(spark, d):
    return ranking.best(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice"], ["o_orderkey"])


@query("""SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part) WHERE k = 1""")
def first_per_group(spark, d):
    return ranking.first(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "p_retailprice")


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3""")
def top_three_per_group(spark, d):
    return ranking.first(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


def _free(claims: str, taken: str) -> str:
    """SQL that names the claims (g, i, id, name, before, after, add) of each group one after another, by the names that it has so far."""
    return f"""WITH RECURSIVE c AS ({claims}), t AS (SELECT g, list(DISTINCT name) AS have FROM ({taken}) GROUP BY 1),
r AS (SELECT c.g, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS got, coalesce(any_value(t.have), CAST([] AS VARCHAR[])) AS have FROM c LEFT JOIN t ON t.g = c.g GROUP BY c.g
 UNION ALL SELECT g, i, id, got, list_append(have, got) FROM (SELECT c.g, c.i, c.id, r.have,
  list_filter(list_transform(range(1, len(have) + 2), lambda k: CASE WHEN k = 1 THEN stem || ending ELSE stem || before || (k + add) || after || ending END), lambda x: NOT list_contains(have, x))[1] AS got
  FROM r JOIN c ON c.g = r.g AND c.i = r.i + 1))"""


_CLAIMS = """SELECT p_type AS g, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i, ' (' AS before, ')' AS after, 0 AS add, '' AS ending,
 p_name || CASE WHEN p_size % 7 = 0 THEN ' (2)' WHEN p_size % 11 = 0 THEN ' (3)' WHEN p_size = 1 THEN ' (2) (2)' ELSE '' END AS stem FROM part"""


@query(_free(_CLAIMS, "SELECT p_type AS g, p_name || ' (4)' AS name FROM part WHERE p_size % 13 = 0 UNION ALL SELECT p_type, p_name FROM part WHERE p_size = 50") + " SELECT id AS p_partkey, got AS unique_name FROM r WHERE id IS NOT NULL")
def unique_destination_names(spark, d):
    """Names until free, with names that are taken, claims of numbered names, and chains of these."""
    size, part = F.col("p_size"), table(spark, d, "part")
    mark = F.when(size % 7 == 0, " (2)").when(size % 11 == 0, " (3)").when(size == 1, " (2) (2)").otherwise("")
    claims = part.select("p_partkey", "p_type", F.concat("p_name", mark).alias("name"))
    taken = part.where("p_size % 13 = 0").select("p_type", F.concat("p_name", F.lit(" (4)")).alias("name")).union(part.where("p_size = 50").select("p_type", "p_name"))
    return naming.free_names(claims, taken, ["p_type"], "name", "p_partkey", "unique_name").select("p_partkey", "unique_name")


@query(_free("SELECT p_type AS g, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i, '-' AS before, '' AS after, -1 AS add, '.3mf' AS ending, p_name || CASE WHEN p_size % 7 = 0 THEN '-1' ELSE '' END AS stem FROM part",
             "SELECT p_type AS g, p_name || '-2.3mf' AS name FROM part WHERE p_size % 13 = 0") + " SELECT id AS p_partkey, got AS filename FROM r WHERE id IS NOT NULL")
def converted_filenames(spark, d):
    """Names of converted files: a number before the ending where one of that name is there."""
    part = table(spark, d, "part")
    claims = part.select("p_partkey", "p_type", F.concat("p_name", F.when(F.col("p_size") % 7 == 0, "-1").otherwise(""), F.lit(".3mf")).alias("name"))
    taken = part.where("p_size % 13 = 0").select("p_type", F.concat("p_name", F.lit("-2.3mf")).alias("name"))
    style = naming.Numbering("-", "", 1, keep_ending=True)
    return naming.free_names(claims, taken, ["p_type"], "name", "p_partkey", "filename", style).select("p_partkey", "filename")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS keep FROM documents""")
def keep_oldest_duplicate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return merging.keep_oldest(docs, ["digest"], [F.col("doc_id")]).select("doc_id", "keep")


@query("""WITH w AS (SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1)
SELECT lines, count(*) AS parts, max(suppliers) AS most FROM w GROUP BY 1""")
def histogram_of_counts(spark, d):
    w = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))
    return w.groupBy("lines").agg(F.count("*").alias("parts"), F.max("suppliers").alias("most"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
def active_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    lines = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity").alias("sum_qty"), _money("l_extendedprice").alias("sum_price"), F.count("*").alias("n"))
