"""JSON lines, data packages, manifests and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAN = "path_a string, path_b string, target string, confidence double, reason string, signals array<string>, run_id string, ts string"
PACKAGE = (
    "name string, title string, description string, keywords array<string>, homepage string, licenses array<struct<name: string, path: string>>, "
    "contributors array<struct<title: string, path: string, roles: array<string>>>, links array<struct<path: string>>, resources array<struct<name: string, path: string, mediatype: string>>"
)


def json_lines(spark: SparkSession, path: str, schema: str = PLAN) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): parsed lines, and the texts of lines that are no JSON object. Blank lines are neither."""
    fields = T.StructType.fromDDL(schema).fields
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in fields]), parsed.where(bad).select("value")


def data_packages(spark: SparkSession, path: str) -> DataFrame:
    """One row per package: title, tags, links with the homepage, first licence, first creator, resources."""
    p = spark.read.schema(PACKAGE).option("multiLine", True).json(path)
    creators = F.filter("contributors", lambda c: F.array_contains(c["roles"], "creator"))
    links = F.array_distinct(F.array_compact(F.concat(F.coalesce(F.transform("links", lambda x: x["path"]), F.array().cast("array<string>")), F.array("homepage"))))
    first = lambda c: F.try_element_at(c, F.lit(1))
    return p.select(
        F.coalesce("title", "name").alias("name"), F.col("description").alias("notes"), F.coalesce("keywords", F.array().cast("array<string>")).alias("tags"), links.alias("links"),
        first(F.col("licenses"))["name"].alias("license"), first(creators)["title"].alias("creator"), F.transform("resources", lambda r: r["path"]).alias("files"),
    )


def export_packages(items: DataFrame, tags: DataFrame, files: DataFrame) -> DataFrame:
    """(id, json): one data package per item (id, name, notes, license), with its tags and files (item_id); nulls are left out."""
    t = tags.groupBy(F.col("item_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("keywords"))
    f = files.groupBy(F.col("item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("filename").alias("path")))).alias("resources"))
    joined = items.join(t, "id", "left").join(f, "id", "left")
    licenses = F.when(F.col("license").isNotNull(), F.array(F.struct(F.col("license").alias("name"))))
    document = F.struct(F.col("name").alias("title"), F.col("notes").alias("description"), "keywords", licenses.alias("licenses"), "resources")
    return joined.select("id", F.to_json(document).alias("json"))


def manifest(spark: SparkSession, path: str, creator: str = "creator", name: str = "name") -> DataFrame:
    """Items of manifest files (a JSON array ``items`` each) by lower-cased creator and name; the last file's entry wins."""
    read = spark.read.option("multiLine", True).json(path).select(F.input_file_name().alias("_file"), F.posexplode("items").alias("_pos", "i"))
    rows = read.select("_file", "_pos", "i.*").withColumn("creator_key", F.lower(F.trim(creator))).withColumn("name_key", F.lower(F.trim(name)))
    return rows.groupBy("creator_key", "name_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("_file", "_pos", "creator_key", "name_key")]), F.struct("_file", "_pos")).alias("item"))


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def write_plan(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header; arrays are joined by blanks."""
    flat = [F.array_join(f.name, " ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def sitemap(frames: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, updated_at) of public, local, indexable rows of several frames."""
    out = None
    for kind, df in frames.items():
        part = df.where("public and local and indexable").select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), "updated_at")
        out = part if out is None else out.unionByName(part)
    return out
