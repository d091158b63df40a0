"""Text functions, search and ranking on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity
from ..functions import text as fn
from ..operators import search
from ..sources import listing
from .registry import query, table


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(lower(trim(o_orderpriority || ' Copy 2')), '\s*(\(\d+\)|copy( of| \d+)?)$', ''), '[^a-z0-9]', '', 'g') AS key FROM orders""")
def text_name_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.name_key(F.concat("o_orderpriority", F.lit(" Copy 2"))).alias("key"))


@query(r"SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM customer")
def text_dashed(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.dashed(F.col("c_name")).alias("slug"))


@query(r"""SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace(replace(p_name, ' ', '_'), '[_-]', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part""")
def text_title(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.title(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("title"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages")
def text_host(spark, d):
    return table(spark, d, "pages").select("page_id", fn.host(F.col("url")).alias("host"))


@query(r"""WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '.') AS p FROM pages)
SELECT CASE WHEN len(p) >= 2 THEN p[-2] ELSE p[-1] END AS site, count(*) AS n FROM h GROUP BY 1""")
def text_site_counts(spark, d):
    return table(spark, d, "pages").select(fn.site(F.col("url")).alias("site")).groupBy("site").agg(F.count("*").alias("n"))


@query(r"SELECT c_custkey, substr(lower(c_name), 1, 1) || '***@***' || '.org' AS masked FROM customer")
def text_masked_email(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.masked_email(F.concat(F.lower("c_name"), F.lit("@mail.example.org"))).alias("masked"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)
SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS folder, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext FROM p""")
def text_parent_and_extension(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", path.alias("path")).select("page_id", fn.parent(F.col("path")).alias("folder"), fn.extension(F.col("path")).alias("ext"))


@query(r"""SELECT p_partkey, string_split(p_name, ' ')[1] AS model, lower(p_brand) AS creator FROM part""")
def text_path_template(spark, d):
    path = F.concat(F.lower("p_brand"), F.lit("/"), F.substring_index("p_name", " ", 1), F.lit("#"), F.col("p_partkey").cast("string"))
    fields = fn.PathTemplate("{creator}/{model_name}").parse(F.col("path"))
    return table(spark, d, "part").select("p_partkey", path.alias("path")).select("p_partkey", fields["model_name"].alias("model"), fields["creator"].alias("creator"))


@query(r"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part)
WHERE length(word) > 1 AND word NOT IN ('cold', 'warm') GROUP BY 1""")
def text_folder_tags(spark, d):
    tags = table(spark, d, "part").select(F.explode(fn.folder_tags(F.concat(F.lit("a/b/"), F.col("p_name")), ["cold", "warm"])).alias("word"))
    return tags.groupBy("word").agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, CASE lower(p_type) WHEN 'promo' THEN 'Sale' WHEN 'economy' THEN 'Sale' WHEN 'large' THEN 'Size' WHEN 'small' THEN 'Size' ELSE 'Unknown' END AS category FROM part""")
def text_category_map(spark, d):
    names = {"Promo": "Sale", "Economy": "Sale", "Large": "Size", "Small": "Size"}
    return table(spark, d, "part").select("p_partkey", fn.mapped(F.col("p_type"), names, "Unknown").alias("category"))


@query(r"SELECT event_id, props AS json FROM events")
def text_recovered_json(spark, d):
    noisy = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", fn.recovered_json(noisy).alias("json"))


@query(r"SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


@query(r"""SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'cold') OR contains(lower(p_name), 'warm')) AND NOT contains(lower(p_name), 'widget') AND lower(p_type) <> 'promo'""")
def search_boolean(spark, d):
    q = search.typed("(cold or Warm) -widget type != promo")
    return table(spark, d, "part").where(search.condition(q, {"name": "p_name", "type": "p_type"}, {}, ["name"])).select("p_partkey")


@query(r"""SELECT o_orderkey FROM orders o WHERE contains(lower(o_orderpriority), 'urgent')
 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')""")
def search_related_tags(spark, d):
    o = search.with_related(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", flags=(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag"))
    q = search.typed("urgent tag = r and not tag=a")
    return o.where(search.condition(q, {"priority": "o_orderpriority"}, {"tag": "flags"}, ["priority"])).select("o_orderkey")


@query(r"""SELECT p_partkey, (SELECT min(levenshtein(w, 'wigdet')) FROM (SELECT unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS w) WHERE w[1] = 'w' AND length(w) BETWEEN 5 AND 7 AND levenshtein(w, 'wigdet') <= 2) AS distance
FROM part WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS w) WHERE w[1] = 'w' AND length(w) BETWEEN 5 AND 7 AND levenshtein(w, 'wigdet') <= 2)""")
def search_edit_distance(spark, d):
    near = similarity.nearest_word("wigdet", F.col("p_name")).alias("distance")
    return table(spark, d, "part").select("p_partkey", near).where("distance is not null")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH g AS (SELECT p_partkey, p_name, {_GRAMS.format("'widget'")} AS a, {_GRAMS.format("p_name")} AS b FROM part),
s AS (SELECT p_partkey, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM g)
SELECT p_partkey, round(score, 6) AS score FROM s WHERE score >= 0.5""")
def search_trigram(spark, d):
    score = F.round(similarity.trigram_similarity(F.lit("widget"), F.col("p_name")), 6)
    return table(spark, d, "part").select("p_partkey", score.alias("score")).where("score >= 0.5")


_WORD = "list_distinct(list_transform(range(1, length('  ' || x || ' ') - 1), lambda i: substr('  ' || x || ' ', i, 3)))"


@query(f"""WITH g AS (SELECT p_partkey, p_name, {_GRAMS.format("'wigdet'")} AS a, {_GRAMS.format("p_name")} AS b, string_split_regex(lower(p_name), '[^a-z0-9]+') AS w FROM part),
s AS (SELECT p_partkey, p_name, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS t,
 list_max(list_transform(list_filter(w, lambda x: x <> ''), lambda x: len(list_intersect(a, {_WORD})) / (len(a) + len({_WORD}) - len(list_intersect(a, {_WORD}))))) AS ws,
 list_min(list_transform(list_filter(w, lambda x: x[1] = 'w' AND length(x) BETWEEN 5 AND 7), lambda x: levenshtein(x, 'wigdet'))) AS e FROM g)
SELECT p_partkey, p_name, round(greatest(t, ws, CASE e WHEN 0 THEN 1 WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 ELSE 0 END), 6) AS rank FROM s
WHERE greatest(t, ws, CASE e WHEN 0 THEN 1 WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 ELSE 0 END) >= 0.5 ORDER BY rank DESC, p_partkey LIMIT 20""")
def search_ranked(spark, d):
    """The twenty best fits of a mistyped word."""
    found = search.fuzzy(table(spark, d, "part").select("p_partkey", "p_name"), "wigdet", "p_name", 0.5, "rank")
    return found.withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), "p_partkey").limit(20)


@query(r"""SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (SELECT unnest(string_split_regex(lower(p_name), '[^a-z0-9]+')) AS w) WHERE w[1] = 'w' AND length(w) BETWEEN 5 AND 7 AND levenshtein(w, 'wigdet') <= 2)
ORDER BY p_partkey LIMIT 200""")
def search_fuzzy_first_by_key(spark, d):
    """Fuzzy hits cut by key before any ranking, as an option."""
    return search.fuzzy(table(spark, d, "part").select("p_partkey", "p_name"), "Wigdet", "p_name", 0.6, first=200, key="p_partkey").select("p_partkey")


@query(r"""SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'cold') AND lower(p_brand) = 'brand#11') OR (contains(lower(p_name), 'warm widget') AND NOT contains(lower(p_type), 'eco')) OR p_size > 48""")
def search_typed_fields(spark, d):
    """Phrases, fields asked for explicitly, negated containment and a field that has any value."""
    parts = table(spark, d, "part").withColumn("flag", F.when(F.col("p_size") > 48, "big"))
    q = search.typed('(cold brand="Brand#11") or ("warm widget" and type !~ eco) or set flag')
    return parts.where(search.condition(q, {"name": "p_name", "brand": "p_brand", "type": "p_type", "flag": "flag"}, {}, ["name"])).select("p_partkey")


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN 'Copy of ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' (2)' ELSE '' END, '^Copy of ', ''), ' \(2\)$', '') || '.stl' AS original FROM part""")
def text_original_name(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 2 == 0, "Copy of ").otherwise(""), "p_name", F.when(k % 3 == 0, " (2)").otherwise(""), F.lit(".stl"))
    return table(spark, d, "part").select("p_partkey", fn.original_name(name).alias("original"))


@query(r"SELECT p_partkey, regexp_replace(p_name, 'w(.)', 'v\1', 'g') || '.Tar' AS renamed FROM part")
def text_renamed(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.renamed(F.concat("p_name", F.lit(".Tar")), "w(.)", "v$1").alias("renamed"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sub/' || p_brand WHEN 1 THEN '../' || p_brand WHEN 2 THEN p_brand ELSE '.' END AS prefix FROM part""")
def text_merge_prefix(spark, d):
    """Where merged files go: under the target, beside it, from another root, and into the target itself."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    target = F.concat(F.col("p_type"), F.lit("/x"))
    source = F.when(k % 4 == 0, F.concat(target, F.lit("/sub/"), brand)).when(k % 4 == 1, F.concat("p_type", F.lit("/"), brand)).when(k % 4 == 2, F.concat(F.lit("other/"), brand)).otherwise(target)
    return table(spark, d, "part").select("p_partkey", fn.merge_prefix(target, source, F.lit(True)).alias("prefix"))


@query(r"""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE s_name END AS creator, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE 'https://www.thingiverse.com/thing:' || s_suppkey END AS url,
CASE s_suppkey % 3 WHEN 1 THEN 'CC-BY-4.0' END AS license, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'A note' ELSE 'Just text by hand' END AS notes FROM supplier""")
def text_readme(spark, d):
    """Readmes in both forms and a free one, with the licence behind the address."""
    s, url = table(spark, d, "supplier"), F.concat(F.lit("https://www.thingiverse.com/thing:"), F.col("s_suppkey").cast("string"))
    short = F.concat(F.lit("Cup by "), "s_name", F.lit(" on Thingiverse: "), url)
    long = F.concat(url, F.lit("\nCup by "), "s_name", F.lit(" is licensed under the Attribution license.\nhttp://creativecommons.org/licenses/by/4.0/\n\n# Summary\n\nA {note %!S(Bool=True)}"))
    read = F.when(F.col("s_suppkey") % 3 == 0, short).when(F.col("s_suppkey") % 3 == 1, long).otherwise("Just text by hand")
    known = spark.createDataFrame([("CC-BY-4.0", "https://creativecommons.org/licenses/by/4.0/legalcode"), ("MIT", "https://opensource.org/license/mit/")], "license string, url string")
    fields = s.select("s_suppkey", fn.readme_fields(read).alias("f")).select("s_suppkey", "f.creator", "f.url", "f.license_url", "f.notes")
    return fn.license_of_url(fields, "license_url", known).select("s_suppkey", "creator", "url", "license", "notes")


@query(r"""SELECT p_type, CASE WHEN regexp_matches(p_name, '(?i)COLD') THEN 'Winter' WHEN regexp_matches(p_name, '(?i)^warm') THEN 'Summer' ELSE 'Unknown' END AS category, count(*) AS n FROM part GROUP BY ALL""")
def text_guessed_category(spark, d):
    rules = [("COLD", "Winter"), ("^warm", "Summer")]
    return table(spark, d, "part").select("p_type", fn.guessed_category(F.col("p_name"), rules).alias("category")).groupBy("p_type", "category").agg(F.count("*").alias("n"))


@query(r"""SELECT p_brand, p_size, (CASE WHEN count(DISTINCT p_type) = 1 THEN 1 ELSE 0 END + 1 + CASE WHEN count(*) = 1 THEN 1 ELSE 0 END) AS same FROM part GROUP BY ALL""")
def text_leading_components(spark, d):
    path = F.concat_ws("/", "p_type", "p_brand", F.col("p_partkey").cast("string"))
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(fn.leading_components(F.collect_list(path)).alias("same"))


_TERMS = """SELECT DISTINCT substr(w, 1, length(w) - 2) || substr(w, length(w), 1) || substr(w, length(w) - 1, 1) AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) UNION SELECT lower(n_name) FROM nation WHERE NOT contains(n_name, ' ')"""


@query(f"""WITH terms AS ({_TERMS}), names AS (SELECT DISTINCT p_name FROM part), g AS (SELECT term, p_name, {_GRAMS.format("term")} AS a, {_GRAMS.format("p_name")} AS b, string_split_regex(lower(p_name), '[^a-z0-9]+') AS w FROM terms, names),
s AS (SELECT term, p_name, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS t,
 list_max(list_transform(list_filter(w, lambda x: x <> ''), lambda x: len(list_intersect(a, {_WORD})) / (len(a) + len({_WORD}) - len(list_intersect(a, {_WORD}))))) AS ws,
 list_min(list_transform(list_filter(w, lambda x: x[1] = term[1] AND length(x) BETWEEN greatest(length(term) - 1, 3) AND length(term) + 1 AND levenshtein(x, term) <= 2), lambda x: levenshtein(x, term))) AS e FROM g)
SELECT term, p_partkey, round(greatest(t, ws, CASE e WHEN 0 THEN 1 WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 ELSE 0 END), 6) AS score FROM s JOIN part USING (p_name)
WHERE greatest(t, ws, CASE e WHEN 0 THEN 1 WHEN 1 THEN 0.85 WHEN 2 THEN 0.7 ELSE 0 END) >= 0.5""")
def search_many_terms(spark, d):
    """All words of names, misspelt, and the names of nations, looked up at once in an index of trigrams."""
    w, part = F.col("w"), table(spark, d, "part")
    swapped = F.concat(F.expr("substr(w, 1, length(w) - 2)"), F.expr("substr(w, length(w), 1)"), F.expr("substr(w, length(w) - 1, 1)"))
    terms = part.select(F.explode(F.split("p_name", " ")).alias("w")).select(swapped.alias("term")).union(table(spark, d, "nation").select(F.lower("n_name").alias("term")))
    return search.fuzzy_many(part.select("p_partkey", "p_name"), terms, "p_name").select("term", "p_partkey", F.round("score", 6).alias("score"))


@query(r"""WITH c AS (SELECT p_partkey AS id, p_type AS g, lower(p_name) AS n, p_partkey % 2 AS side FROM part),
m AS (SELECT g, n, min(id) AS match FROM c WHERE side = 1 GROUP BY ALL) SELECT id, match FROM c JOIN m USING (g, n) WHERE side = 0""")
def supported_version(spark, d):
    """The most similar name in the same group; here equal names, which have cosine 1."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("g"), F.col("p_name").alias("name"))
    return similarity.best_in_group(parts.where("id % 2 = 0"), parts.where("id % 2 = 1"), ["g"], "id", "name", 0.999999).select("id", "match")


@query(r"""WITH c AS (SELECT p_partkey AS id, p_type AS g, lower(p_name) || ' ' || p_size AS n FROM part),
v AS (SELECT g, n, map_from_entries(list(row(ch, k))) AS m, sqrt(sum(k * k)) AS len FROM (SELECT g, n, ch, count(*) AS k FROM (SELECT g, n, unnest(string_split(n, '')) AS ch FROM (SELECT DISTINCT g, n FROM c)) GROUP BY ALL) GROUP BY ALL),
p AS (SELECT a.g, a.n AS x, b.n AS y, list_sum(list_transform(map_keys(a.m), lambda k: a.m[k] * coalesce(b.m[k], 0))) / (a.len * b.len) AS score FROM v a JOIN v b USING (g)),
s AS (SELECT l.id, r.id AS match, score FROM c l JOIN p ON p.g = l.g AND p.x = l.n JOIN c r ON r.g = p.g AND r.n = p.y WHERE l.id % 2 = 0 AND r.id % 2 = 1 AND score > 0.95)
SELECT id, match, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, match) = 1""")
def similar_version(spark, d):
    """The most similar name in the same group, at a cosine of over 0.95."""
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("g"), name.alias("name"))
    found = similarity.best_in_group(parts.where("id % 2 = 0"), parts.where("id % 2 = 1"), ["g"], "id", "name", 0.95)
    return found.select("id", "match", F.round("score", 6).alias("score"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Unnamed' ELSE substr(replace(p_name, ' ', ' ') || ' ' || p_type, 1, 100) END AS name FROM part""")
def text_display_name(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 5 == 0, "Copy of  ??").otherwise(F.concat(F.lit("Copy of copy of "), "p_name", F.lit("  /"), "p_type", F.lit("_20240102_030405")))
    return table(spark, d, "part").select("p_partkey", fn.display_name(raw).alias("name"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS INT) END AS number, p_partkey % 2 = 0 OR p_partkey % 3 = 0 AS copy, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (' || p_size || ')' ELSE '' END AS bare FROM part""")
def text_copy_marks(spark, d):
    """Numbers and marks of copies in names, and names without repeated prefixes."""
    k = F.col("p_partkey")
    end = F.concat("p_name", F.when(k % 2 == 0, F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(""))
    name = F.concat(F.when(k % 3 == 0, "Copy of copy OF ").otherwise(""), end)
    return table(spark, d, "part").select("p_partkey", fn.copy_number(name).alias("number"), fn.is_copy_name(name).alias("copy"), fn.without_copy_prefix(name).alias("bare"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '/' END || p_type || '/' || p_brand AS trimmed FROM part""")
def text_trim_slashes(spark, d):
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("//"), "p_type", F.lit("/"), "p_brand", F.lit("/"))
    return table(spark, d, "part").select("p_partkey", fn.trim_slashes(path).alias("trimmed"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '@unattributed' ELSE replace(lower(p_brand), '#', '-') END || '/' || CASE WHEN p_size % 2 = 0 THEN '@untagged' ELSE replace(p_name, ' ', '/') END || '/' || replace(p_name, ' ', '-') || '#' || p_partkey AS path FROM part""")
def text_path_format(spark, d):
    size = F.col("p_size")
    creator, tags = F.when(size % 3 > 0, F.col("p_brand")), F.when(size % 2 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    path = fn.PathTemplate("{creator}/{tags}/{model_name}").format(creator, F.lit(None).cast("string"), F.col("p_name"), tags, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


@query(r"""SELECT p_partkey FROM part WHERE regexp_matches(lower(p_type || '/' || p_name || '.stl'), '(^|[\s/._()\[\]-])(cold|promo)($|[\s/._()\[\]-])')""")
def text_has_keyword(spark, d):
    return table(spark, d, "part").where(fn.has_keyword(F.concat("p_type", F.lit("/"), "p_name", F.lit(".stl")), ["cold", "promo"])).select("p_partkey")


_COUNTS = "list_transform(range(97, 123), lambda c: length({0}) - length(replace({0}, chr(c::INTEGER), '')))"


@query(f"""WITH v AS (SELECT p_partkey, {_COUNTS.format("lower(replace(p_name, ' ', ''))")} AS x, {_COUNTS.format("lower(p_type)")} AS y FROM part)
SELECT p_partkey, round(list_dot_product(x::DOUBLE[], y::DOUBLE[]) / sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[]) * list_dot_product(y::DOUBLE[], y::DOUBLE[])), 6) AS score FROM v""")
def text_cosine(spark, d):
    score = similarity.cosine(F.lower(F.replace("p_name", F.lit(" "))), F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query(r"""SELECT count(*) AS n, count(*) AS distinct_ids, true AS plain FROM customer""")
def text_public_id(spark, d):
    ids = table(spark, d, "customer").select(fn.public_id(F.col("c_custkey")).alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.bool_and(F.col("id").rlike("^[0-9b-df-hj-np-tv-z]{12}$")).alias("plain"))


@query(r"""SELECT s_suppkey, 'host' || s_suppkey || '.example.org' || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ':8080' ELSE '' END AS server FROM supplier""")
def text_server_and_port(spark, d):
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://Host"), k.cast("string"), F.lit(".example.org"), F.when(k % 3 == 0, "").when(k % 3 == 1, ":8080").otherwise(":443"), F.lit("/a?b"))
    return table(spark, d, "supplier").select("s_suppkey", fn.server_and_port(url).alias("server"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || '/' || p_name WHEN 1 THEN p_type || '/' || p_name END AS entry FROM part""")
def text_safe_entry(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("./"), "p_type", F.lit("/"), "p_name")).when(k % 4 == 1, F.concat("p_type", F.lit("\\"), "p_name")).when(k % 4 == 2, F.concat(F.lit("a/../"), "p_name")).otherwise(F.concat(F.lit("C:\\"), "p_name"))
    return table(spark, d, "part").select("p_partkey", fn.safe_entry(path).alias("entry"))


@query(r"""SELECT CASE o_orderkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'role' WHEN 2 THEN 'group' ELSE 'user' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def text_subject_kind(spark, d):
    k = F.col("o_orderkey")
    token = F.when(k % 4 == 0, "role::public").when(k % 4 == 1, "role::member").when(k % 4 == 2, F.concat(F.lit("group::"), k.cast("string"))).otherwise(k.cast("string"))
    return table(spark, d, "orders").select(fn.subject_kind(token).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(r"""SELECT DISTINCT p_type || CASE WHEN p_size % 3 = 2 THEN '/other' ELSE '' END AS folder FROM part""")
def text_model_folder(spark, d):
    """The folders of models, without a common sub-folder at the end."""
    size = F.col("p_size")
    path = F.concat("p_type", F.when(size % 3 == 0, "/").when(size % 3 == 1, "/STL/").otherwise("/other/"), "p_name", F.lit(".stl"))
    return table(spark, d, "part").select(path.alias("path")).select(listing.model_folder().alias("folder")).distinct()
