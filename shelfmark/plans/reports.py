"""A catalogue mapped onto the driver's tables: parts are items, line items their files, name words their tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import detectors, filters, geometry, merging, ranking, tree
from ..sources import archives
from .registry import query, table

_FILES = """f AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS id, l_partkey AS item_id, 'File' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.STL' WHEN 'N' THEN '.png' ELSE '.pdf' END AS filename,
 CAST(floor(l_quantity) AS BIGINT) - 1 AS size, l_suppkey || ':' || l_partkey AS digest FROM lineitem)"""
_ITEMS = """i AS (SELECT p_partkey AS id, p_brand AS library_id, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN ' ' ELSE 'MIT' END AS license, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS creator_id FROM part)"""


def _catalogue(spark, d):
    size = F.col("p_size")
    part = table(spark, d, "part")
    items = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("library_id"), F.lit(None).cast("int").alias("collection_id"), F.when(size <= 40, size).alias("creator_id"),
        F.col("p_name").alias("name"), F.when(size % 4 == 1, " ").when(size % 4 > 1, "MIT").alias("license"), F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string")).alias("path"),
    )
    ending = F.when(F.col("l_returnflag") == "A", ".STL").when(F.col("l_returnflag") == "N", ".png").otherwise(".pdf")
    files = table(spark, d, "lineitem").select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("id"), F.col("l_partkey").alias("item_id"), F.concat(F.lit("File"), F.col("l_linenumber").cast("string"), ending).alias("filename"),
        (F.floor("l_quantity") - 1).alias("size"), F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("digest"),
    )
    tags = part.select(F.col("p_partkey").alias("item_id"), F.explode(F.split("p_name", " ")).alias("tag"))
    links = part.where("p_size % 7 = 0").select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("https://example.org/"), F.col("p_brand")).alias("url"))
    return {"items": items, "files": files, "tags": tags, "links": links}


@query(f"""WITH {_FILES}, {_ITEMS}, p AS (
SELECT 'empty' AS category, id FROM i WHERE id NOT IN (SELECT item_id FROM f)
UNION ALL SELECT 'no_image', id FROM i WHERE id NOT IN (SELECT item_id FROM f WHERE filename LIKE '%.png')
UNION ALL SELECT 'no_mesh', id FROM i WHERE id NOT IN (SELECT item_id FROM f WHERE filename LIKE '%.STL')
UNION ALL SELECT 'no_license', id FROM i WHERE trim(coalesce(license, '')) = ''
UNION ALL SELECT 'no_creator', id FROM i WHERE creator_id IS NULL
UNION ALL SELECT 'duplicate', id FROM f WHERE size > 0 AND filename NOT LIKE '%.pdf' AND digest IN (SELECT digest FROM f WHERE size > 0 AND filename NOT LIKE '%.pdf' GROUP BY 1 HAVING count(*) > 1))
SELECT category, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS ids FROM p GROUP BY 1""")
def problem_report(spark, d):
    found = detectors.detect(_catalogue(spark, d), ["empty", "no_image", "no_mesh", "no_license", "no_creator", "duplicate"])
    return found.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000003).alias("ids"))


@query(f"""WITH {_FILES}, {_ITEMS} SELECT id FROM i WHERE library_id IN (SELECT min(p_brand) FROM part)
AND id IN (SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')) AND id NOT IN (SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(^| )cold'))
AND id IN (SELECT item_id FROM f WHERE filename LIKE '%.png') AND creator_id IS NOT NULL""")
def catalogue_filter(spark, d):
    t = _catalogue(spark, d)
    lowest = t["items"].agg(F.min("library_id").alias("library_id"))  # the request's library
    items = t["items"].join(F.broadcast(lowest), "library_id", "left_semi").where("creator_id is not null")
    shelf = filters.Catalogue(items, t["tags"], t["links"], None, t["files"])
    return shelf.filtered(filters.FilterSpec.of({"tags": ["widget"], "missing_tag": "^cold", "has_image": "1"})).select("id")


@query(f"""WITH {_FILES} SELECT CASE WHEN filename LIKE '%.STL' THEN 'mesh' WHEN filename LIKE '%.png' THEN 'image' ELSE 'document' END AS class, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def file_classes(spark, d):
    files = _catalogue(spark, d)["files"].withColumn("class", filters.file_class(fn.extension(F.col("filename"))))
    return files.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"""WITH {_FILES} SELECT id FROM f WHERE NOT (filename LIKE 'File7%' OR regexp_matches('p' || item_id, '00$'))""")
def ignored_files(spark, d):
    files = _catalogue(spark, d)["files"].withColumn("path", F.concat_ws("/", F.concat(F.lit("p"), F.col("item_id").cast("string")), "filename"))
    return files.where(~filters.ignored(F.col("path"), ["^File7", "00$"])).select("id")


@query(f"""WITH {_FILES}, r AS (SELECT item_id, filename, id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN filename LIKE '%.png' THEN 10 WHEN filename LIKE '%.STL' THEN 50 ELSE 100 END, id) AS k FROM f)
SELECT item_id, filename FROM r WHERE k = 1""")
def preview_pick(spark, d):
    files = _catalogue(spark, d)["files"]
    return ranking.first(files, ["item_id"], [ranking.preview_priority(F.col("filename")), F.col("id")]).select("item_id", "filename")


@query("SELECT count(*) AS overlapping FROM (SELECT DISTINCT p_type || '/' || p_brand AS path FROM part) a JOIN (SELECT DISTINCT p_type AS path FROM part) b ON starts_with(a.path, b.path || '/')")
def overlapping_libraries(spark, d):
    parts = table(spark, d, "part")
    paths = parts.select(F.concat_ws("/", "p_type", "p_brand").alias("path")).union(parts.select("p_type")).distinct().withColumn("all", F.lit(1))
    return tree.nested(paths, "path", "path", ["all"]).agg(F.count("*").alias("overlapping"))


@query("SELECT sha1(lower(p_type || '/' || p_name)) AS id, min(CASE p_type WHEN 'PROMO' THEN 'Sale' ELSE 'Other' END) AS category, count(*) AS n FROM part GROUP BY 1")
def inventory_catalogue(spark, d):
    rows = table(spark, d, "part").select(F.sha1(F.lower(F.concat_ws("/", "p_type", "p_name"))).alias("id"), fn.mapped(F.col("p_type"), {"promo": "Sale"}, "Other").alias("category"))
    return rows.groupBy("id").agg(F.min("category").alias("category"), F.count("*").alias("n"))


@query("""WITH RECURSIVE f AS (SELECT l_partkey AS item, 'Part' || l_suppkey || '-' || l_linenumber AS filename FROM lineitem),
g AS (SELECT item, greatest(2, CAST(round(count(*) * 0.05) AS BIGINT)) AS enough, max(length(filename)) AS longest, list(lower(filename)) AS names FROM f GROUP BY 1),
r AS (SELECT item, enough, longest AS n, names, CAST([] AS STRUCT(name VARCHAR, section VARCHAR)[]) AS found FROM g
 UNION ALL SELECT item, enough, n - 1, list_filter(names, lambda x: NOT list_contains(ready, x[1:n - 1])), list_concat(found, list_transform(list_filter(names, lambda x: list_contains(ready, x[1:n - 1])), lambda x: {'name': x, 'section': x[1:n - 1]})) FROM (
  SELECT *, list_filter(list_distinct(list_transform(names, lambda x: x[1:n - 1])), lambda p: len(list_filter(names, lambda x: x[1:n - 1] = p)) >= enough) AS ready FROM r WHERE n > 3)),
d AS (SELECT item, u.name, any_value(u.section) AS section FROM (SELECT item, unnest(found) AS u FROM r WHERE n = 3) GROUP BY item, u.name)
SELECT f.item, filename, section FROM f LEFT JOIN d ON d.item = f.item AND d.name = lower(filename)""")
def prefix_sections(spark, d):
    """Files of each part under common beginnings of their names."""
    files = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.concat(F.lit("Part"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("filename"))
    return ranking.prefix_sections(files, "item", "filename")


@query(f"""WITH {_FILES}, k AS (SELECT id, row_number() OVER (PARTITION BY lower(filename), size ORDER BY id) AS k, count(*) OVER (PARTITION BY lower(filename), size) AS n FROM f) SELECT id, k = 1 AS keep FROM k WHERE n > 1""")
def copy_clean_up(spark, d):
    files = _catalogue(spark, d)["files"].withColumn("key", F.lower("filename"))
    many = detectors.repeated(files, ["key", "size"]).select("key", "size")
    return merging.keep_oldest(files.join(many, ["key", "size"], "left_semi"), ["key", "size"], [F.col("id")]).select("id", "keep")


@query(f"""WITH {_FILES}, u AS (SELECT DISTINCT * FROM f),
c AS (SELECT id, item_id AS folder, CASE WHEN id % 7 = 0 THEN 'Copy of ' || filename ELSE filename END AS name, size, digest, id % 7 = 0 AS marked, id % 1000 AS age FROM u),
a AS (SELECT id, 'copy-name' AS reason FROM c WHERE marked), r AS (SELECT * FROM c WHERE NOT marked),
b AS (SELECT id, k FROM (SELECT id, row_number() OVER (PARTITION BY folder, lower(name), size ORDER BY age, name, id) AS k FROM r) WHERE k > 1),
h AS (SELECT id, row_number() OVER (PARTITION BY size, digest ORDER BY age, folder, name, id) AS k FROM r WHERE size >= 10 AND id NOT IN (SELECT id FROM b))
SELECT id, reason FROM a UNION ALL SELECT id, 'same-name-size' FROM b UNION ALL SELECT id, 'sha256' FROM h WHERE k > 1""")
def copy_passes(spark, d):
    """Three passes of a clean-up over the files, of which every seventh has the name of a copy."""
    files = _catalogue(spark, d)["files"].repartition("item_id").distinct()
    name = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Copy of "), "filename")).otherwise(F.col("filename"))
    rows = files.select("id", F.col("item_id").alias("folder"), name.alias("name"), "size", "digest", (F.col("id") % 1000).alias("modified"))
    return merging.copy_passes(rows, 10).select("id", "reason")


@query(f"""WITH {_FILES}, u AS (SELECT DISTINCT * FROM f), d AS (SELECT *, id % 5 <> 0 AS there FROM u),
p AS (SELECT item_id, id FROM (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN filename LIKE '%.png' THEN 10 WHEN filename LIKE '%.STL' THEN 50 ELSE 100 END, id) AS k FROM d WHERE there) WHERE k = 1),
o AS (SELECT p_partkey AS item_id, CASE WHEN p_size % 3 > 0 THEN m.id END AS preview FROM part LEFT JOIN (SELECT item_id, max(id) AS id FROM u GROUP BY 1) m ON m.item_id = p_partkey),
r AS (SELECT o.item_id, p.id AS preview_id, CASE WHEN preview IS NULL THEN CASE WHEN p.id IS NOT NULL THEN 'unset' END WHEN NOT d.there THEN 'broken' WHEN d.filename NOT LIKE '%.png' AND p.id <> preview THEN 'no_image' END AS reason
 FROM o LEFT JOIN p USING (item_id) LEFT JOIN d ON d.id = preview)
SELECT item_id, reason, preview_id FROM r WHERE reason IS NOT NULL""")
def healed_previews(spark, d):
    """New previews for items whose own is broken (every fifth file is gone), unset, or no image."""
    t = _catalogue(spark, d)
    files = t["files"].distinct().withColumn("on_disk", F.col("id") % 5 != 0)
    last = files.groupBy("item_id").agg(F.max("id").alias("last"))
    own = table(spark, d, "part").join(last, F.col("p_partkey") == F.col("item_id"), "left")
    items = own.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 > 0, F.col("last")).alias("preview_id"))
    return ranking.healed_previews(items, files)


@query(f"""WITH {_FILES}, i AS (SELECT p_partkey AS id, p_type || '/' || p_brand || '/' || p_partkey AS path, CASE WHEN p_size % 2 = 0 THEN p_type || '/' || p_brand || '/' || p_partkey ELSE lower(p_type) END AS wanted FROM part),
p AS (SELECT 'file_naming' AS category, id FROM i WHERE path <> wanted UNION ALL SELECT 'empty_file', id FROM f WHERE size = 0
 UNION ALL SELECT 'missing_item', id FROM i WHERE id % 4 = 0
 UNION ALL SELECT 'inefficient', id FROM f WHERE filename LIKE '%.STL' AND item_id % 2 = 1
 UNION ALL SELECT 'missing_library', n_nationkey FROM nation WHERE n_nationkey % 3 = 1)
SELECT category, count(*) AS n, CAST(sum(id % 1000003) AS BIGINT) AS ids FROM p GROUP BY 1""")
def problem_report_formats(spark, d):
    """Detectors of storage, naming and format."""
    t = _catalogue(spark, d)
    part = table(spark, d, "part")
    sizes = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string"))).otherwise(F.lower("p_type")).alias("formatted_path"))
    t["items"] = t["items"].join(sizes, "id")
    t["files"] = t["files"].withColumn("head", F.when(F.col("item_id") % 2 == 1, "solid cube").otherwise("binary"))
    t["listing"] = part.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("item_id"))
    t["libraries"] = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("path"))
    t["mounted"] = t["libraries"].where("id % 3 <> 1").select("path")
    found = detectors.detect(t, ["file_naming", "empty_file", "missing_item", "missing_library", "inefficient"])
    return found.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000003).alias("ids"))


@query(f"""WITH {_FILES}, {_ITEMS}, p AS (SELECT id AS item_id, 'no_creator' AS category FROM i WHERE creator_id IS NULL UNION ALL SELECT item_id, 'empty_file' FROM f WHERE size = 0)
SELECT item_id, max(category = 'empty_file') AS empty_file, count(*) AS n FROM p GROUP BY 1""")
def problems_with_files(spark, d):
    """Problems of items together with those of their files."""
    t = _catalogue(spark, d)
    found = detectors.problems_with_files(detectors.detect(t, ["no_creator", "empty_file"]), t["files"].distinct())
    return found.groupBy("item_id").agg(F.max(F.col("category") == "empty_file").alias("empty_file"), F.count("*").alias("n"))


@query(f"""WITH {_ITEMS}, g AS (SELECT id, array_to_string(list_filter([CASE WHEN trim(coalesce(license, '')) = '' THEN 'license' END, CASE WHEN creator_id IS NULL THEN 'creator' END,
 CASE WHEN creator_id IS NOT NULL AND creator_id % 2 = 1 THEN 'creator_private' END], lambda x: x IS NOT NULL), ',') AS issues FROM i WHERE id % 3 > 0)
SELECT id, issues FROM g WHERE issues <> ''""")
def unpublishable_items(spark, d):
    """Public items without licence or creator, or of a creator that is not public."""
    items = _catalogue(spark, d)["items"]
    creators = items.where("creator_id is not null").select(F.col("creator_id").alias("id")).distinct()
    public = items.where("id % 3 > 0").select(F.lit("item").alias("kind"), F.col("id").cast("long").alias("id")).union(creators.where("id % 2 = 0").select(F.lit("creator"), F.col("id").cast("long")))
    return detectors.unpublishable(items, creators, public).select("id", F.array_join("issues", ",").alias("issues"))


@query(f"""WITH {_FILES}, {_ITEMS} SELECT 'files.item' AS "check", count(*) AS n FROM f WHERE item_id NOT IN (SELECT id FROM i)
UNION ALL SELECT 'items.creator', count(*) FROM i WHERE creator_id NOT IN (SELECT id FROM range(0, 30) t(id)) UNION ALL SELECT 'items.collection', 0
UNION ALL SELECT 'items.library', count(*) FROM i WHERE library_id NOT IN (SELECT p_brand FROM part WHERE p_size > 10)
UNION ALL SELECT 'items.preview', count(*) FROM i WHERE id * 10 NOT IN (SELECT id FROM f)
UNION ALL SELECT 'merges.source_library', count(*) FROM supplier WHERE 'Brand#' || s_suppkey NOT IN (SELECT p_brand FROM part WHERE p_size > 10) UNION ALL SELECT 'merges.target', count(*) FROM supplier WHERE s_suppkey * 30 NOT IN (SELECT id FROM i)
UNION ALL SELECT 'memberships.group', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0) UNION ALL SELECT 'memberships.user', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'files.repeated_name', (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY item_id, filename HAVING count(*) > 1)) UNION ALL SELECT 'files.no_digest', count(*) FROM f WHERE item_id % 11 = 0""")
def integrity_checks(spark, d):
    """The eleven checks of references, names and digests."""
    t = _catalogue(spark, d)
    part, sup, cust = (table(spark, d, n) for n in ("part", "supplier", "customer"))
    of = lambda df, c: df.select(F.col(c).alias("id"))
    return detectors.integrity({
        "items": t["items"].withColumn("preview_id", F.col("id") * 10), "files": t["files"].withColumn("digest", F.when(F.col("item_id") % 11 != 0, F.col("digest"))),
        "creators": spark.range(30), "collections": spark.range(0), "libraries": of(part.where("p_size > 10"), "p_brand").distinct(),
        "merges": sup.select(F.concat(F.lit("Brand#"), F.col("s_suppkey").cast("string")).alias("source_library_id"), (F.col("s_suppkey") * 30).alias("target_id")),
        "groups": of(table(spark, d, "nation").where("n_regionkey > 0"), "n_nationkey"), "users": of(table(spark, d, "orders"), "o_custkey"),
        "memberships": cust.select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("user_id")),
    })


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderpriority AS p, o_orderkey % 4 = 0 AS ignored FROM orders),
g AS (SELECT id, CASE p WHEN '1-URGENT' THEN 'danger' WHEN '2-HIGH' THEN 'warning' WHEN '3-MEDIUM' THEN 'info' ELSE 'silent' END AS severity FROM c WHERE NOT ignored)
SELECT id, severity, CASE severity WHEN 'danger' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END AS rank FROM g WHERE severity <> 'silent'""")
def shown_problems(spark, d):
    """Problems that a user sees, with their own severity for one category."""
    named = {"1-URGENT": "missing", "2-HIGH": "nesting", "3-MEDIUM": "no_tags"}
    category = F.coalesce(F.create_map(*[F.lit(x) for k, v in named.items() for x in (k, v)])[F.col("o_orderpriority")], F.lit("no_links"))
    problems = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), category.alias("category"), (F.col("o_orderkey") % 4 == 0).alias("ignored"))
    return detectors.shown(problems, {"no_tags": "info"}).select("id", "severity", "rank")


@query("""SELECT l_orderkey AS item_id, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS bytes, count(*) AS files, max(l_returnflag = 'N') AS image FROM lineitem GROUP BY 1 HAVING count(*) >= 6""")
def pack_scores(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"))
    return lines.agg(F.sum(F.floor("l_quantity")).alias("bytes"), F.count("*").alias("files"), F.max(F.col("l_returnflag") == "N").alias("image")).where("files >= 6")


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN 'delete' WHEN p_size % 3 = 1 THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM part WHERE p_size % 3 > 0 OR p_size % 2 = 0 GROUP BY 1""")
def archive_changes(spark, d):
    """What brings stored archive entries to what an archive now lists."""
    size = F.col("p_size")
    parts = table(spark, d, "part").select(F.col("p_brand").alias("archive"), F.col("p_partkey").cast("string").alias("pathname"), size)
    stored = parts.where((size % 3 == 1) | ((size % 3 == 0) & (size % 2 == 0))).select("archive", "pathname", F.col("p_size").alias("size"))
    listed = parts.where(size % 3 > 0).select("archive", "pathname", (F.col("p_size") + 1).alias("size"))
    return archives.synchronise(stored, listed).groupBy("action").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE t AS (SELECT 3 AS node UNION ALL SELECT n_nationkey FROM nation JOIN t ON n_nationkey % 8 = node AND n_nationkey > node)
SELECT p_partkey AS id FROM part WHERE p_size IN (SELECT node FROM t) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N')""")
def filter_collection_subtree(spark, d):
    """Items of a collection and those below it, with an image since no word is searched and that is the default."""
    t = _catalogue(spark, d)
    items = t["items"].drop("collection_id").join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("collection_id")), "id")
    k = F.col("n_nationkey")
    collections = table(spark, d, "nation").select(k.alias("node"), F.when(k >= 8, k % 8).alias("up"))
    below = tree.below(collections, collections.where("node = 3"), "node", "up")
    spec = filters.FilterSpec.of({}, default_has_image=True)
    within = filters.having(items, below, "collection_id", "node")
    return filters.Catalogue(within, t["tags"], t["links"], None, t["files"]).filtered(spec).select("id")


_FACES = """c AS (SELECT p_partkey AS mesh, p_size AS s, [{'x': 0, 'y': 0, 'z': 0}, {'x': p_size, 'y': 0, 'z': 0}, {'x': 0, 'y': p_size % 7, 'z': 0}, {'x': 0, 'y': 0, 'z': p_partkey % 5}] AS p FROM part),
f AS (SELECT mesh, p[t.a] AS a, p[t.b] AS b, p[t.c] AS c FROM c, (VALUES (1, 1, 2, 3), (2, 1, 2, 4), (3, 1, 3, 4), (4, 2, 3, 4), (5, 2, 3, 4)) t(k, a, b, c) WHERE k < 4 OR (k = 4 AND s % 3 > 0) OR (k = 5 AND s % 4 = 0))"""


def _meshes(spark, d):
    """Parts as tetrahedra, of which some lack a face, have one twice, or are flat."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("int")
    point = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    zero = F.lit(0)
    corners = table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), size.alias("s"), F.array(point(zero, zero, zero), point(size, zero, zero), point(zero, size % 7, zero), point(zero, zero, key % 5)).alias("p"))
    faces = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("kuvw", f)]) for f in ((1, 0, 1, 2), (2, 0, 1, 3), (3, 0, 2, 3), (4, 1, 2, 3), (5, 1, 2, 3))])
    each = corners.withColumn("f", F.explode(faces)).where("f.k < 4 or (f.k = 4 and s % 3 > 0) or (f.k = 5 and s % 4 = 0)")
    return each.select("mesh", *[F.get("p", F.col(f"f.{n}")).alias(c) for n, c in zip("uvw", "abc")])


@query(f"""WITH {_FACES}, g AS (SELECT * FROM f WHERE a <> b AND b <> c AND a <> c),
e AS (SELECT mesh, least(x, y) AS u, greatest(x, y) AS v, count(*) AS n FROM (SELECT mesh, a AS x, b AS y FROM g UNION ALL SELECT mesh, b, c FROM g UNION ALL SELECT mesh, a, c FROM g) GROUP BY ALL),
m AS (SELECT mesh, CAST(sum(n) / 3 AS BIGINT) AS triangles, count(*) AS edges, count(*) FILTER (n = 1) AS open_edges, count(*) FILTER (n > 2) AS crowded_edges FROM e GROUP BY 1)
SELECT DISTINCT mesh, coalesce(triangles, 0) AS triangles, coalesce(edges, 0) AS edges, coalesce(open_edges, 0) AS open_edges, coalesce(crowded_edges, 0) AS crowded_edges, coalesce(open_edges + crowded_edges = 0, false) AS manifold
FROM f LEFT JOIN m USING (mesh)""")
def manifold_meshes(spark, d):
    """Which meshes are closed surfaces."""
    return geometry.manifold(_meshes(spark, d))


@query(f"""WITH {_FACES}, q AS (SELECT mesh, unnest([a, b, c]) AS p FROM f) SELECT mesh, max(p.x) - min(p.x) AS width, max(p.y) - min(p.y) AS depth, max(p.z) - min(p.z) AS height FROM q GROUP BY 1""")
def mesh_sizes(spark, d):
    return geometry.bounds(_meshes(spark, d)).select("mesh", F.col("size.x").alias("width"), F.col("size.y").alias("depth"), F.col("size.z").alias("height"))


@query("""SELECT o_custkey, o_orderpriority AS role, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1""")
def duplicate_roles(spark, d):
    roles = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("role"))
    return detectors.repeated(roles, ["o_custkey", "role"])
