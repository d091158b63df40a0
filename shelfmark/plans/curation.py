"""Access and curation decisions on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access, decisions
from .aggregates import _free
from .registry import query, table


def _grants(spark, d):
    """Customers' grants: an owner each, with an edge to a role or to everyone for some."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("object"))
    own = c.select("object", F.concat(F.lit("user::"), F.col("object").cast("string")).alias("subject"), F.lit("own").alias("permission"))
    role = c.where("object % 3 = 1").select("object", F.lit("role::member").alias("subject"), F.lit("view").alias("permission"))
    every = c.where("object % 3 = 2").select("object", F.lit(None).cast("string").alias("subject"), F.lit("view").alias("permission"))
    return own.union(role).union(every)


@query("SELECT c_custkey AS object, CASE c_custkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'member' ELSE 'public' END AS preset FROM customer")
def permission_presets(spark, d):
    return access.presets(_grants(spark, d))


@query("""SELECT CASE WHEN c_custkey <= 50 THEN 'public' WHEN c_custkey % 3 = 0 THEN 'private' WHEN c_custkey % 3 = 1 THEN 'member' ELSE 'public' END AS preset, count(*) AS n FROM customer GROUP BY 1""")
def permission_preset_applied(spark, d):
    some = table(spark, d, "customer").where("c_custkey <= 50").select(F.col("c_custkey").alias("object"))
    return access.presets(access.with_preset(_grants(spark, d), some, "public")).groupBy("preset").agg(F.count("*").alias("n"))


_CREATORS = "k AS (SELECT n_nationkey AS id, CASE WHEN n_name < 'J' THEN 'yes' WHEN n_name < 'S' THEN 'no' END AS v FROM nation)"


def _creators(spark, d):
    name = F.col("n_name")
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(name < "J", "yes").when(name < "S", "no").otherwise("inherit").alias("indexable"))


@query(f"""WITH RECURSIVE {_CREATORS}, c AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey - 1 END AS parent, s_nationkey AS creator, CASE WHEN s_acctbal < 0 THEN 'no' WHEN s_acctbal > 9000 THEN 'yes' END AS own FROM supplier),
e AS (SELECT c.id, coalesce(own, v, 'yes') AS indexable FROM c LEFT JOIN k ON k.id = creator WHERE parent IS NULL UNION ALL SELECT c.id, coalesce(own, e.indexable) FROM e JOIN c ON c.parent = e.id)
SELECT 'item' AS kind, c_custkey AS id, coalesce(CASE WHEN c_acctbal < 0 THEN 'no' END, k.v, 'yes') AS indexable FROM customer LEFT JOIN k ON k.id = c_nationkey
UNION ALL SELECT 'collection', id, indexable FROM e UNION ALL SELECT 'creator', id, coalesce(v, 'yes') FROM k""")
def effective_indexability(spark, d):
    """Of all that has it: items, whose collections do not count, collections, each tenth the topmost of those after it, and creators."""
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("creator_id"), F.when(F.col("c_acctbal") < 0, "no").alias("indexable"))
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    collections = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 10 > 0, k - 1).alias("parent_id"), F.col("s_nationkey").alias("creator_id"), F.when(balance < 0, "no").when(balance > 9000, "yes").alias("indexable"))
    creators = _creators(spark, d)
    own = creators.withColumn("creator_id", F.lit(None).cast("int"))
    found = {"item": access.indexable(items, creators, "yes"), "collection": access.collections_indexable(collections, creators, "yes"), "creator": access.indexable(own, creators, "yes")}
    return reduce(DataFrame.unionByName, (df.select(F.lit(kind).alias("kind"), F.col("id").cast("long"), "indexable") for kind, df in found.items()))


@query(f"""WITH RECURSIVE {_CREATORS}, c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1000 > 0 THEN o_orderkey - 1 END AS parent, o_orderkey // 1000 % 25 AS creator,
 CASE WHEN o_custkey % 97 = 0 THEN 'yes' WHEN o_custkey % 89 = 0 THEN 'no' END AS own FROM orders),
e AS (SELECT c.id, coalesce(own, v, 'no') AS indexable FROM c LEFT JOIN k ON k.id = creator WHERE parent IS NULL UNION ALL SELECT c.id, coalesce(own, e.indexable) FROM e JOIN c ON c.parent = e.id) SELECT id, indexable FROM e""")
def collections_indexability(spark, d):
    """Of collections in chains of a thousand, each in the one before."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    own = F.when(cust % 97 == 0, "yes").when(cust % 89 == 0, "no")
    collections = table(spark, d, "orders").select(k.alias("id"), F.when(k % 1000 > 0, k - 1).alias("parent_id"), (F.floor(k / 1000) % 25).alias("creator_id"), own.alias("indexable"))
    return access.collections_indexable(collections, _creators(spark, d))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0 OR (o_custkey % 3 = 0 AND o_orderstatus = 'F')""")
def visible_files(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("item_id"), (F.col("o_orderstatus") == "F").alias("previewable"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    # Orders of customers that are not in the table are of no item; the SQL names orders by key alone.
    c = c.union(files.select(F.col("item_id").alias("id"))).distinct()
    out = access.visible_files(files, c.where("id % 2 = 0"), c.where("id % 3 = 0"), "previewable")
    return out.select("o_orderkey", F.col("item_id").alias("o_custkey"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, least(CAST(floor(l_extendedprice) AS BIGINT), 2000000) + CASE WHEN l_returnflag = 'A' THEN 1000000 ELSE 0 END - CASE WHEN l_returnflag = 'R' THEN 1500000 ELSE 0 END - 50000 AS score,
 CASE l_returnflag WHEN 'A' THEN 'x/cover' WHEN 'R' THEN 'x/logo' ELSE 'x/other' END || l_linenumber AS path FROM lineitem)
SELECT l_orderkey, path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= 2""")
def ranked_images(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "x/cover").when(F.col("l_returnflag") == "R", "x/logo").otherwise("x/other")
    images = table(spark, d, "lineitem").select("l_orderkey", F.concat(name, F.col("l_linenumber").cast("string")).alias("path"), F.floor("l_extendedprice").cast("long").alias("size"))
    return decisions.ranked_images(images, "l_orderkey", "path", "size", 2).select("l_orderkey", "path", "score", "rank")


@query("""WITH b AS (SELECT lower(p_name) AS title, lower(p_type) AS creator, count(*) AS rows, max(p_size) AS most, max(struct_pack(s := p_size, b := p_brand)).b AS richest, max(CASE WHEN p_brand = 'Brand#11' THEN p_size END) AS own FROM part GROUP BY ALL)
SELECT title, creator, CASE WHEN own >= 0.95 * most THEN 'Brand#11' ELSE richest END AS source, rows FROM b""")
def cross_source_titles(spark, d):
    """Which source's pack of a title stays: the preferred one if it is nearly as rich."""
    packs = table(spark, d, "part").select(F.col("p_type").alias("creator"), F.upper("p_name").alias("title"), F.col("p_brand").alias("source"), F.col("p_size").cast("long").alias("bytes"), F.lit(1).alias("files"), F.lit(True).alias("image"))
    return decisions.cross_source(packs, "Brand#11").select("title", "creator", "source", "rows")


@query("""SELECT a.o_orderkey AS k, CASE WHEN b.o_orderkey IS NULL THEN 'move' WHEN a.o_totalprice > b.o_totalprice THEN 'replace_with_richer' ELSE 'quarantine_loser' END AS action
FROM orders a LEFT JOIN (SELECT o_orderkey - 1 AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 1) b USING (o_orderkey)""")
def import_plan(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("bytes"), F.lit(1).alias("files"))
    present = o.where("k % 2 = 1").withColumn("k", F.col("k") - 1)
    return decisions.import_plan(o, present, ["k"]).select("k", "action")


@query("""SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN 'skip' WHEN p_size < 20 THEN 'move' WHEN p_size < 30 THEN 'rename' ELSE 'keep' END AS action FROM part""")
def organise_decisions(spark, d):
    size, same = F.col("p_size"), F.col("p_type")
    folders = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), same.alias("category"), F.col("p_name").alias("name"),
        F.when(size < 10, "unknown").when(size < 20, "Moved").otherwise(same).alias("new_category"),
        F.when(size.between(20, 29), F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("new_name"),
    )
    return decisions.organise(folders, ["Moved", "ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]).select("id", "action")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) >= 60 AS sensitive FROM events""")
def sensitive_decision(spark, d):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    found = F.array(F.struct(F.lit("HOT").alias("label"), k.alias("score")), F.struct(F.lit("ARM_EXPOSED").alias("label"), (k - 1).alias("score")))
    return table(spark, d, "events").select("event_id", decisions.is_sensitive(found, ["HOT"]).alias("sensitive"))


_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH h AS (SELECT DISTINCT {_KEY.format("CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_type ELSE p_type || ' ' || p_brand || ' large' END")} AS k FROM part WHERE p_size > 46),
w AS (SELECT p_partkey, {_KEY.format("p_name || ' ' || p_type || ' ' || p_brand")} AS k FROM part)
SELECT p_partkey, EXISTS (SELECT 1 FROM h WHERE h.k = w.k OR (length(h.k) > 12 AND length(w.k) > 12 AND (contains(h.k, w.k) OR contains(w.k, h.k)))) AS found FROM w""")
def present_by_name(spark, d):
    """Whether a name is there, or one that it contains or that contains it."""
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"), "p_name", "p_type", "p_brand", "p_size")
    other = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat_ws(" ", "p_type", "p_brand", F.lit("large")))
    return decisions.present_by_name(parts, parts.where("p_size > 46").select(other.alias("name")), "name").select("p_partkey", "found")


@query("""WITH i AS (SELECT c_custkey AS id, c_nationkey AS actor FROM customer), a AS (SELECT n_nationkey AS id, n_regionkey < 2 AS local FROM nation WHERE n_nationkey < 20)
SELECT 'local' AS scope, count(*) AS n FROM i JOIN a ON actor = a.id WHERE local UNION ALL SELECT 'remote', count(*) FROM i JOIN a ON actor = a.id WHERE NOT local
UNION ALL SELECT 'mergeable', count(*) FROM i LEFT JOIN a ON actor = a.id WHERE coalesce(local, true)
UNION ALL SELECT 'searchable', count(*) FROM i JOIN a ON actor = a.id WHERE local OR i.id % 3 = 0""")
def actor_scopes(spark, d):
    """Items of local and of remote actors, and those that may be merged or searched."""
    items = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("actor_id"), F.when(F.col("c_custkey") % 3 == 0, "yes").otherwise("no").alias("indexable"))
    actors = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") < 2).alias("local"))
    scopes = {"local": access.local_only, "remote": access.remote_only, "mergeable": access.mergeable, "searchable": access.searchable}
    return reduce(DataFrame.union, [f(items, actors).agg(F.count("*").alias("n")).select(F.lit(k).alias("scope"), "n") for k, f in scopes.items()])


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 AS local, CASE WHEN s_suppkey % 5 > 0 THEN 'User' END AS entity_type FROM supplier""")
def repaired_actors(spark, d):
    k = F.col("s_suppkey")
    actors = table(spark, d, "supplier").select("s_suppkey", (k % 2 == 0).alias("local"), F.when(k % 3 > 0, "far.example.org").otherwise("here.example.org").alias("server"), F.lit("User").alias("entity_type"), F.when(k % 5 > 0, k).alias("entity_id"))
    return access.repaired_actors(actors, "here.example.org").select("s_suppkey", "local", "entity_type")


@query("""SELECT o_orderkey AS folder FROM orders WHERE o_orderstatus = 'F' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def still_to_do(spark, d):
    """Folders without a preview or a known category."""
    folders = table(spark, d, "orders").select(F.col("o_orderkey").alias("folder"), F.when(F.col("o_orderstatus") == "F", "Unknown").otherwise("Cars").alias("category"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("folder"), F.when(F.col("l_returnflag") == "R", "Preview.jpg").otherwise("x.stl").alias("name"))
    return decisions.still_to_do(folders, files).select("folder")


@query(r"""SELECT DISTINCT url, CASE WHEN contains(url, '/es/') THEN 'item' WHEN contains(url, '/fr/') THEN 'collection' ELSE 'creator' END AS kind FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)""")
def import_by_url(spark, d):
    """Addresses that no link has yet, with the kind of item that they stand for."""
    pages = table(spark, d, "pages")
    return decisions.import_by_url(pages, pages.where("page_id % 3 = 0"), [("/es/", "item"), ("/fr/", "collection")], "creator")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL""")
def without_sensitive(spark, d):
    items = table(spark, d, "customer").withColumn("sensitive", F.col("c_acctbal") < 0)
    return access.without_sensitive(items, "hide").select("c_custkey")


@query(_free("""SELECT p_type AS g, p_partkey AS id, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i, ' (' AS before, ')' AS after, 0 AS add, '' AS ending, p_type || '/' || p_name AS stem
 FROM part WHERE p_size >= 10 AND p_size < 40 AND p_partkey % 9 > 0""", "SELECT p_type AS g, p_type || '/' || p_name || CASE WHEN p_size > 45 THEN ' (3)' ELSE '' END AS name FROM part WHERE p_size >= 44") + """
SELECT p_partkey AS id, CASE WHEN p_size >= 40 OR p_partkey % 9 = 0 THEN 'keep' WHEN p_size < 20 THEN 'move' ELSE 'rename' END AS action, got AS destination,
 CASE WHEN p_size >= 40 OR p_partkey % 9 = 0 THEN 'no_move_needed' WHEN p_size < 10 THEN 'low_confidence' ELSE 'planned' END AS status FROM part LEFT JOIN (SELECT id, got FROM r WHERE id IS NOT NULL) q ON q.id = p_partkey""")
def move_plan(spark, d):
    """Moves and renames with destinations that neither each other nor what is there has."""
    size, parts = F.col("p_size"), table(spark, d, "part")
    target = F.concat_ws("/", "p_type", "p_name")
    decided = parts.select(
        F.col("p_partkey").alias("id"), F.when(size < 20, "move").when(size < 40, "rename").otherwise("keep").alias("action"), target.alias("target"), (size / 50).alias("confidence"),
        F.when(F.col("p_partkey") % 9 == 0, target).otherwise("elsewhere").alias("current"),
    )
    there = parts.where("p_size >= 44").select(F.concat(target, F.when(size > 45, " (3)").otherwise("")).alias("target"))
    return decisions.move_plan(decided, there, 0.2)


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) / 100 AS top, 'HOT,ARM_EXPOSED' AS labels FROM events""")
def detection_summary(spark, d):
    k = F.get_json_object("props", "$.k").cast("double") / 100
    found = F.array(F.struct(F.lit("HOT").alias("label"), k.alias("score")), F.struct(F.lit("ARM_EXPOSED").alias("label"), (k - 1).alias("score")))
    return table(spark, d, "events").select("event_id", decisions.detection_summary(found).alias("s")).select("event_id", F.col("s.top").alias("top"), F.array_join("s.labels", ",").alias("labels"))
