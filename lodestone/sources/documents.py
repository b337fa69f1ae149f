"""Scans of JSON documents, event logs, dossiers, manifests and source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars as S

SCHEMA_VERSION = 2
EDGE = "struct<target:string,kind:string,via:string,where:string,confidence:string>"
NODE = f"id string, schema_version int, primitive string, kind string, name string, owner string, source struct<repo:string,path:string,language:string,line:int,end_line:int>, signature struct<decorators:array<string>,bases:array<string>,method:string,path:string,url_pattern:string,returns_jsx:boolean>, edges_out array<{EDGE}>, structural_hash string, dossier string"
EVENT = "ts string, kind string, tool string, file_path string, node_id string, rule_id string, matched_phrase string"
#: Languages by file extension.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "sql": "sql"}


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Node documents below a folder; paths with a part that starts with _ are left out, broken documents too."""
    raw = spark.read.schema(NODE + ", _corrupt_record string").option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    raw = raw.withColumn("file", F.input_file_name())
    return raw.where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & ~F.col("file").rlike(r"/_[^/]*(/|$)")).drop("_corrupt_record")


def current(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the current schema version, and the ids and versions of the others."""
    fits = F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False))
    return found.where(fits), found.where(~fits).select("id", "schema_version")


def edges(found: DataFrame) -> DataFrame:
    """src, dst, kind, via, where, confidence from the nodes' lists."""
    return found.select(F.col("id").alias("src"), F.inline("edges_out")).withColumnRenamed("target", "dst")


def dependents(spark: SparkSession, path: str) -> DataFrame:
    """dst, src, kind from a reverse index in either form: flat, or wrapped in by_target."""
    row = "array<struct<source:string,kind:string,via:string,where:string,confidence:string>>"
    text = spark.read.text(path, wholetext=True)
    flat = F.from_json("value", f"map<string,{row}>")
    wrapped = F.from_json("value", f"struct<by_target:map<string,{row}>>")["by_target"]
    return text.select(F.explode(F.coalesce(wrapped, flat)).alias("dst", "in")).select("dst", F.inline("in")).withColumnRenamed("source", "src")


def events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """An event log of JSON lines, broken lines left out, from a time on; ts_raw keeps the text."""
    got = spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    got = got.withColumn("ts_raw", F.col("ts")).withColumn("ts", F.try_to_timestamp("ts"))
    return got.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else got


def dossiers(spark: SparkSession, folder: str) -> DataFrame:
    """file, fm (front matter as a map), body of markdown files."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    block = S.frontmatter(F.col("value"))
    fm = F.map_from_entries(F.transform(F.map_entries(block), lambda e: F.struct(F.trim(e["key"]), F.trim(e["value"]))))
    return raw.select(F.input_file_name().alias("file"), fm.alias("fm"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "").alias("body"))


def languages(spark: SparkSession, folder: str) -> DataFrame:
    """language, n of the source files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    named = files.select(known[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))].alias("language"))
    return named.where("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("n"))


def packages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, package of package.json and requirements files."""
    raw = spark.read.text(paths, wholetext=True).withColumn("file", F.input_file_name())
    keys = F.array_union(*[F.coalesce(F.map_keys(F.from_json(F.get_json_object("value", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    npm = raw.where("file LIKE '%package.json'").select("file", F.explode(keys).alias("package"))
    lines = raw.where("file LIKE '%.txt'").select("file", F.explode(F.split("value", "\n")).alias("line"))
    pip = lines.select("file", F.lower(F.regexp_extract("line", r"^\s*([A-Za-z0-9._-]+)", 1)).alias("package")).where("package <> ''")
    return npm.unionByName(pip).distinct()
