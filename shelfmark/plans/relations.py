"""Joins, trees, detectors, reconciliation and merge plans on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, merging, tree
from ..staging import staged
from .registry import query, table


def _tree(spark, d):
    """Regions, nations and customers as one tree: key and parent, tagged by level."""
    key = lambda level, c: F.concat(F.lit(level), F.col(c).cast("string"))
    r = table(spark, d, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up"))
    n = table(spark, d, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("up"))
    c = table(spark, d, "customer").select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("up"))
    return r.union(n).union(c)


_TREE = """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS node, NULL AS up FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
t AS (SELECT node, 0 AS depth FROM e WHERE node = 'r1' UNION ALL SELECT e.node, t.depth + 1 FROM e JOIN t ON e.up = t.node) """


@query(_TREE + "SELECT node, depth FROM t")
def tree_below(spark, d):
    nodes = _tree(spark, d)
    return tree.below(nodes, nodes.where("node = 'r1'"), "node", "up")


@query(_TREE + "SELECT node FROM t WHERE depth > 0 AND node LIKE 'n%'")
def tree_between(spark, d):
    nodes = _tree(spark, d)
    return tree.between(nodes, nodes.where("node = 'r1'"), nodes.where("node like 'n%'"), "node", "up")


@query(_TREE + """SELECT t.depth, count(*) AS nodes, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM t LEFT JOIN customer ON t.node = 'c' || c_custkey GROUP BY 1""")
def tree_rollup(spark, d):
    nodes = _tree(spark, d)
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), "c_acctbal")
    under = tree.below(nodes, nodes.where("node = 'r1'"), "node", "up")
    return under.join(c, "node", "left").groupBy("depth").agg(F.count("*").alias("nodes"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


_PATHS = "SELECT DISTINCT p_type || '/' || p_brand AS path FROM part UNION ALL SELECT p_type || '/' || p_brand || '/' || p_partkey FROM part UNION ALL SELECT DISTINCT p_type FROM part"


def _paths(spark, d):
    """Parts as folders, with the folders above them as items of their own."""
    parts = table(spark, d, "part")
    two = parts.select(F.concat_ws("/", "p_type", "p_brand").alias("path")).distinct()
    return two.union(parts.select(F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")))).union(parts.select("p_type").distinct()).withColumn("library", F.lit(1))


@query("""SELECT p_type || '/' || p_brand AS outer, p_type || '/' || p_brand || '/' || p_partkey AS inner FROM part UNION ALL SELECT p_type, p_type || '/' || p_brand || '/' || p_partkey FROM part
UNION ALL SELECT DISTINCT p_type, p_type || '/' || p_brand FROM part""")
def nested_paths(spark, d):
    return tree.nested(_paths(spark, d), "path", "path", ["library"])


@query(f"""WITH i AS ({_PATHS}), r AS (SELECT path FROM i WHERE path LIKE 'P%/%' AND path NOT LIKE '%/%/%'), u AS (SELECT r.path AS root, i.path, length(i.path) AS n FROM r JOIN i ON i.path = r.path OR starts_with(i.path, r.path || '/'))
SELECT root, path, row_number() OVER (PARTITION BY root ORDER BY n DESC, path) AS step FROM u""")
def deletion_order(spark, d):
    """What goes with each folder of the second level under P..., deepest first."""
    items = _paths(spark, d)
    chosen = items.where("path like 'P%/%' and path not like '%/%/%'")
    return tree.deletion_order(items, chosen, "path", "path", ["library"])


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey <> o_orderkey THEN o_custkey END AS parent FROM orders")
def self_parents(spark, d):
    return tree.without_self_parents(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent")), "id", "parent")


@query("""SELECT p_type, CASE WHEN count(DISTINCT p_brand) = 1 THEN p_type || '/' || min(p_brand) ELSE p_type END AS root FROM part GROUP BY 1""")
def common_roots(spark, d):
    parts = table(spark, d, "part").select("p_type", F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"))
    found = tree.common_root(parts, ["p_type"], "path")
    return found


@query("""WITH k AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) AS a FROM part) SELECT a, p_partkey AS b FROM k WHERE a < p_partkey""")
def name_pairs(spark, d):
    return merging.name_pairs(table(spark, d, "part"), "p_partkey", "p_name", "p_brand")


@query("""WITH f AS (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
s AS (SELECT l_orderkey AS item, list(l_partkey * 100 + n ORDER BY l_partkey, n) AS facts FROM f GROUP BY 1),
c AS (SELECT item, min(item) OVER (PARTITION BY facts) AS first, len(facts) AS size FROM s)
SELECT a.l_orderkey AS a, b.l_orderkey AS b, count(*) AS overlap FROM f a JOIN f b ON a.l_partkey = b.l_partkey AND a.n = b.n AND a.l_orderkey < b.l_orderkey
WHERE a.l_orderkey IN (SELECT first FROM c) AND b.l_orderkey IN (SELECT first FROM c) GROUP BY 1, 2 HAVING count(*) >= 2
UNION ALL SELECT first, item, size FROM c WHERE first < item AND size >= 2""")
def overlap_pairs(spark, d):
    """Orders that share lines; those of the very same lines pair with the first of them."""
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return merging.overlap_pairs(facts, "l_orderkey", ["l_partkey", "l_linenumber"], 2)


@query("""WITH n AS (SELECT a, p_partkey AS b FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_type), lower(p_name)) AS a FROM part) WHERE a < p_partkey),
s AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS s, l_quantity AS q, CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN l_suppkey || ':' || l_quantity END AS d FROM lineitem),
h AS (SELECT DISTINCT a, item AS b FROM (SELECT item, min(item) OVER (PARTITION BY d) AS a FROM s WHERE d IS NOT NULL) WHERE a < item),
o AS (SELECT a.item AS a, b.item AS b, count(*) AS overlap FROM (SELECT DISTINCT item, s, q FROM s) a JOIN (SELECT DISTINCT item, s, q FROM s) b ON a.s = b.s AND a.q = b.q AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 3),
u AS (SELECT a, b, 'name_near_dupe' AS signal, 0 AS overlap FROM n UNION ALL SELECT a, b, 'shared_digest', 0 FROM h UNION ALL SELECT a, b, 'file_overlap', overlap FROM o),
g AS (SELECT a, b, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, max(overlap) AS overlap FROM u GROUP BY 1, 2)
SELECT a, b, signals, CASE WHEN a % 5 = 0 THEN CASE WHEN b % 2 = 0 THEN 'merge' ELSE 'separate' END WHEN contains(signals, 'name_near_dupe') OR contains(signals, 'shared_digest') THEN 'merge' ELSE 'separate' END AS decision,
CASE WHEN a % 5 = 0 THEN 0.9 WHEN contains(signals, 'shared_digest') THEN 0.85 WHEN contains(signals, 'name_near_dupe') THEN 0.82 ELSE 0.0 END AS confidence FROM g""")
def merge_candidates_gated(spark, d):
    """Candidates by name, digest and files; every fifth has previews and a verdict."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    digest = F.when((F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1), F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("string")))
    files = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").cast("string").alias("name"), F.col("l_quantity").alias("size"), digest.alias("digest"))
    pairs = merging.candidates(items, files)
    gated = merging.decide(pairs, F.col("a") % 5 == 0, F.when(F.col("b") % 2 == 0, "merge").otherwise("separate"), F.lit(0.9), 0.8)
    return gated.select("a", "b", F.array_join("signals", ",").alias("signals"), "decision", "confidence")


@query("""WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS a FROM documents WHERE text IS NOT NULL) SELECT a, doc_id AS b FROM h WHERE a < doc_id""")
def digest_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).where("h is not null")
    return merging.class_pairs(docs, ["h"], "doc_id")


_LINE_ID = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"


def _line_files(spark, d):
    """Lines as files of their orders, of few names and digests, so that many meet."""
    text = lambda c: F.col(c).cast("string")
    id_ = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    return table(spark, d, "lineitem").select(id_.alias("id"), F.col("l_orderkey").alias("item"), F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string"), F.lit(".stl")).alias("name"), (F.col("l_suppkey") % 3).cast("string").alias("digest")).repartition("item").distinct()


@query(f"""WITH RECURSIVE f AS (SELECT DISTINCT {_LINE_ID} AS id, l_orderkey AS item, 'p' || l_partkey % 5 AS stem, CAST(l_suppkey % 3 AS VARCHAR) AS digest FROM lineitem),
m AS (SELECT o_orderkey AS source, o_orderkey - o_orderkey % 8 AS target FROM orders WHERE o_orderkey % 8 > 0),
e AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY -source, id) AS i, source, id, stem || '.stl' AS name, stem, digest FROM m JOIN f ON item = source),
o AS (SELECT item, list({{'n': stem || '.stl', 'd': digest, 'f': id}} ORDER BY id) AS have FROM f GROUP BY 1),
r AS (SELECT target, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS source, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS new_name, CAST(NULL AS BIGINT) AS same_as,
  coalesce(any_value(have), []) AS have FROM (SELECT DISTINCT target FROM e) t LEFT JOIN o ON item = target GROUP BY target
 UNION ALL SELECT target, i, source, id, action, new_name, CASE action WHEN 'drop' THEN hit.f END, CASE action WHEN 'drop' THEN have ELSE list_append(have, {{'n': new_name, 'd': digest, 'f': id}}) END FROM (
  SELECT *, CASE action WHEN 'adopt' THEN name WHEN 'rename' THEN stem || '_' || digest || '.stl' END AS new_name FROM (
  SELECT *, CASE WHEN hit IS NULL THEN 'adopt' WHEN hit.d = digest THEN 'drop' ELSE 'rename' END AS action FROM (
  SELECT e.*, have, list_filter(have, lambda x: x.n = name)[1] AS hit FROM r JOIN e ON e.target = r.target AND e.i = r.i + 1))))
SELECT source, target, id AS file_id, action, new_name, same_as FROM r WHERE i > 0""")
def merge_plan(spark, d):
    """Seven orders into each eighth, the last first; every other one by way of the first of them."""
    k = F.col("o_orderkey")
    target = F.when(k % 2 == 0, k - k % 8 + 1).otherwise(k - k % 8)
    merges = table(spark, d, "orders").where(k % 8 > 0).select(k.alias("source"), target.alias("target"), (-k).alias("at"))
    planned = merging.merge_targets(merges).where("status = 'merge'").drop("status")
    return merging.merge_plan(_line_files(spark, d), planned).select("source", "target", "file_id", "action", "new_name", "same_as")


@query("""WITH RECURSIVE m AS (SELECT o_orderkey AS source, CASE WHEN o_orderkey % 100 = 99 THEN o_orderkey - 2 WHEN o_orderkey % 100 > 0 THEN o_orderkey + CASE WHEN o_orderkey % 100 < 97 THEN -1 ELSE 1 END END AS target FROM orders WHERE o_orderkey % 100 > 0),
r AS (SELECT source, target, 1 AS n FROM m UNION ALL SELECT r.source, m.target, n + 1 FROM r JOIN m ON m.source = r.target WHERE n < 200),
z AS (SELECT source, max(target) FILTER (target % 100 = 0) AS target FROM r GROUP BY 1)
SELECT source, target, CASE WHEN target IS NULL THEN 'loop' ELSE 'merge' END AS status FROM z UNION ALL SELECT o_orderkey, NULL, 'again' FROM orders WHERE o_orderkey % 100 = 50""")
def merge_chains(spark, d):
    """Chains of up to 96 merges, three items in a ring, and sources that are merged twice."""
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    target = F.when(k % 100 == 99, k - 2).when(k % 100 < 97, k - 1).otherwise(k + 1)
    merges = orders.where(k % 100 > 0).select(k.alias("source"), target.alias("target"), k.alias("at")).union(orders.where(k % 100 == 50).select(k, k + 7, k + 1_000_000))
    return merging.merge_targets(merges).select("source", "target", "status")


@query("""WITH m AS (SELECT o_orderkey AS source, o_orderkey + 1 AS target, o_orderdate AS merged, o_custkey % 7 = 0 AS undone FROM orders),
f AS (SELECT DISTINCT l_orderkey, l_linenumber * 100000 + l_partkey AS id, l_partkey AS name, CAST(l_suppkey AS VARCHAR) AS digest FROM lineitem),
h AS (SELECT l_orderkey, name, min(id) AS id, arg_min(digest, (id, digest)) AS digest FROM f GROUP BY ALL)
SELECT source, target, s.id AS file_id, max(CASE WHEN t.name IS NOT NULL THEN CASE WHEN t.digest = s.digest THEN 'create' ELSE 'move' END WHEN o.id <> s.id AND o.digest = s.digest THEN 'create' ELSE 'move' END) AS action
FROM m JOIN f s ON s.l_orderkey = source LEFT JOIN h t ON t.l_orderkey = target AND t.name = s.name JOIN h o ON o.l_orderkey = source AND o.name = s.name
WHERE NOT undone AND merged >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY GROUP BY ALL""")
def unmerge_plan(spark, d):
    """What undoing recent merges does with each file, from the histories that the merges left."""
    text = lambda c: F.col(c).cast("string")
    files = table(spark, d, "lineitem").select((F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("item"), text("l_partkey").alias("name"), text("l_suppkey").alias("digest")).repartition("item").distinct()
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") + 1).alias("target"), F.col("o_orderdate").alias("merged_at"), F.when(F.col("o_custkey") % 7 == 0, F.col("o_orderdate")).alias("undone_at"))
    histories = merging.history(merging.merge_plan(files, o.select("source", "target"))).join(o, ["source", "target"])
    plan = merging.unmerge_plan(histories, F.expr("timestamp_ntz'1998-01-01'"), 90)
    return plan.groupBy("source", "target", "file_id").agg(F.max("action").alias("action"))


@query("""SELECT l_orderkey AS item, count(*) FILTER (l_returnflag <> 'R') AS stays, count(*) FILTER (l_returnflag = 'R') AS moves FROM lineitem GROUP BY 1""")
def split_items(spark, d):
    """Returned lines split off their order into a copy of it."""
    rows = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("item"), "l_returnflag")
    rows = staged(rows, "rows")
    previews = rows.groupBy("item").agg(F.min("id").alias("preview_id"))
    files, _ = merging.split_plan(rows, rows.where("l_returnflag = 'R'"), previews, -F.col("item") - 1)
    of = F.when(F.col("item") < 0, -F.col("item") - 1).otherwise(F.col("item"))
    return files.groupBy(of.alias("item")).agg(F.count_if(F.col("item") >= 0).alias("stays"), F.count_if(F.col("item") < 0).alias("moves"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_totalprice / 500000 < 0.8 THEN 'low_confidence' WHEN c_custkey IS NULL THEN 'unknown_path' ELSE 'apply' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'""")
def plan_status(spark, d):
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path_a"), F.col("o_custkey").alias("path_b"), (F.col("o_totalprice") / 500000).alias("confidence"))
    paths = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("path"))
    return merging.apply_status(plan, paths).select("id", "status")


@query("""WITH f AS (SELECT DISTINCT l_orderkey * 100000 + l_partkey AS id, l_orderkey AS folder, l_partkey % 4 AS base, l_partkey % 7 AS n, l_partkey AS size FROM lineitem),
k AS (SELECT id, folder, n, size, CASE WHEN base % 2 = 0 AND n % 2 = 1 THEN 'FILE' ELSE 'File' END || base || CASE WHEN n > 0 THEN ' (' || n || ')' ELSE '' END || '.stl' AS name,
 CASE WHEN base % 2 = 0 AND n % 2 = 1 THEN 'FILE' ELSE 'File' END || base || '.stl' AS bare FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(bare) ORDER BY n, size, name, id) AS k, max(n = 0) OVER (PARTITION BY folder, lower(bare)) AS plain FROM k)
SELECT id, CASE WHEN k = 1 AND NOT plain THEN 'promote' ELSE 'delete' END AS action, CASE WHEN k = 1 AND NOT plain THEN bare END AS new_name FROM r WHERE n > 0""")
def numbered_copies(spark, d):
    """Files with a number behind their name, beside the one without it or instead of it."""
    f = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("folder"), F.col("l_partkey").alias("size")).distinct()
    base, n = F.col("size") % 4, F.col("size") % 7
    stem = F.concat(F.when((base % 2 == 0) & (n % 2 == 1), "FILE").otherwise("File"), base.cast("string"))
    return merging.numbered_copies(f.withColumn("name", F.concat(stem, F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(""), F.lit(".stl"))))


@query("""WITH k AS (SELECT p_partkey AS b, min(p_partkey) OVER (PARTITION BY p_brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) AS a FROM part),
n AS (SELECT p_partkey AS id, p_name || CASE WHEN p_size % 3 = 0 THEN ' (2)' ELSE '' END AS name, p_size FROM part)
SELECT a, b, CASE WHEN y.p_size > 45 THEN CASE WHEN b % 2 = 0 THEN b ELSE a END WHEN length(x.name) <= length(y.name) THEN a ELSE b END AS target,
 CASE WHEN y.p_size > 45 THEN CASE WHEN b % 2 = 0 THEN a ELSE b END WHEN length(x.name) <= length(y.name) THEN b ELSE a END AS source FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE a < b""")
def merge_directions(spark, d):
    """Which of two items stays: the one of the shorter name, or what a look at both said."""
    part = table(spark, d, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " (2)").otherwise("")).alias("name"), "p_size")
    pairs = merging.name_pairs(part, "p_partkey", "p_name", "p_brand").withColumn("decision", F.lit("merge")).join(names.select(F.col("id").alias("b"), "p_size"), "b")
    return merging.with_target(pairs, names.select("id", "name"), F.col("p_size") > 45, F.when(F.col("b") % 2 == 0, "B").otherwise("a")).select("a", "b", "target", "source")


@query("""SELECT o_orderkey AS id, trim(CASE WHEN o_orderkey % 3 = 0 THEN '/' ELSE '' END || o_orderpriority || '/' || o_custkey, '/') || CASE WHEN o_custkey % 5 = 0 THEN '--unmerged-' || o_orderkey ELSE '' END AS new_path FROM orders WHERE o_orderkey % 4 > 0""")
def unmerged_paths(spark, d):
    """Paths of items that are made again, of which some are taken by now."""
    o = table(spark, d, "orders")
    path = F.concat_ws("/", "o_orderpriority", F.col("o_custkey").cast("string"))
    past = o.where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("source_library_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "/").otherwise(""), path).alias("source_path"))
    return merging.unmerged_paths(past, o.where("o_custkey % 5 = 0").select(F.lit(1).alias("library_id"), path.alias("path"))).select("id", "new_path")


@query("""WITH s AS (SELECT c_custkey AS id, 'resolving' AS state FROM customer WHERE c_custkey % 3 = 0),
d AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT d.id, CASE WHEN s.state = 'resolving' THEN 'resolving' ELSE 'detected' END AS state, false AS ignored, s.id IS NOT NULL AS known FROM d LEFT JOIN s USING (id)""")
def problem_update(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    stored = c.where("id % 3 = 0").select("id", F.lit("resolving").alias("state"))
    return detectors.update(stored, c.where("c_acctbal < 0"), ["id"])


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def problem_duplicates(spark, d):
    return detectors.duplicates(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("""SELECT 'orders.customer' AS "check", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'supplier.nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)""")
def integrity_report(spark, d):
    t = lambda n: table(spark, d, n)
    return detectors.orphans({
        "orders.customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"),
        "lineitem.order": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"),
        "supplier.nation": (t("supplier"), "s_nationkey", t("nation").where("n_regionkey > 0"), "n_nationkey"),
    })


@query("""SELECT o_custkey, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) WHEN 3 THEN 'danger' WHEN 2 THEN 'warning' ELSE 'info' END AS severity
FROM orders GROUP BY 1""")
def worst_severity(spark, d):
    own = {"1-URGENT": "danger", "2-HIGH": "warning", "3-MEDIUM": "info", "4-NOT SPECIFIED": "info", "5-LOW": "info"}
    problems = table(spark, d, "orders").select("o_custkey", F.coalesce(F.create_map(*[F.lit(x) for k, v in own.items() for x in (k, v)])[F.col("o_orderpriority")], F.lit("info")).alias("level"))
    by_level = {"danger": "missing", "warning": "nesting", "info": "empty"}
    problems = problems.withColumn("category", F.create_map(*[F.lit(x) for k, v in by_level.items() for x in (k, v)])[F.col("level")])
    return detectors.worst(problems, ["o_custkey"])


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_joins(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT kind, count(*) AS n FROM (SELECT 'supplier' AS kind, s_nationkey AS k FROM supplier UNION ALL SELECT 'customer', c_nationkey FROM customer) JOIN nation ON n_nationkey = k AND n_regionkey = 2 GROUP BY 1""")
def polymorphic_join(spark, d):
    owned = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("k")).union(table(spark, d, "customer").select(F.lit("customer"), "c_nationkey"))
    return owned.join(table(spark, d, "nation").where("n_regionkey = 2"), F.col("k") == F.col("n_nationkey"), "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, coalesce(s1.s_name, s2.s_name) AS source FROM part LEFT JOIN supplier s1 ON s1.s_suppkey = p_partkey LEFT JOIN supplier s2 ON s2.s_suppkey = p_partkey % 10 + 1""")
def cascade_match(spark, d):
    s = table(spark, d, "supplier")
    one, two = s.select(F.col("s_suppkey").alias("k1"), F.col("s_name").alias("n1")), s.select(F.col("s_suppkey").alias("k2"), F.col("s_name").alias("n2"))
    p = table(spark, d, "part").join(one, F.col("p_partkey") == F.col("k1"), "left").join(two, F.col("p_partkey") % 10 + 1 == F.col("k2"), "left")
    return p.select("p_partkey", F.coalesce("n1", "n2").alias("source"))


@query("""SELECT lower(p_name) AS name, arg_max(p_brand, CAST(p_size * 1000000 + p_partkey AS BIGINT)) AS winner, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def richer_duplicate_wins(spark, d):
    score = (F.col("p_size") * 1000000 + F.col("p_partkey")).cast("long")
    parts = table(spark, d, "part").groupBy(F.lower("p_name").alias("name")).agg(F.max_by("p_brand", score).alias("winner"), F.count("*").alias("n"))
    return parts.where("n > 1")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE n_name END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def fill_blanks(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).otherwise("").alias("label"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    other = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.col("n_name").alias("label"))
    return merging.fill_blanks(own, other, "c_custkey", ["label"])


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(p_name, ' '), ['new']), lambda x: x <> 'cold'))), ',') AS tags FROM part""")
def tag_arithmetic(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(merging.with_tags(F.split("p_name", " "), ["new"], ["cold"]), ",").alias("tags"))


@query("""SELECT (SELECT count(*) FROM customer) - (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS hidden""")
def locked_count(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.select(F.col("o_custkey").alias("k")).distinct(), F.col("c_custkey") == F.col("k"), "left").agg(F.count_if(F.col("k").isNull()).alias("hidden"))
