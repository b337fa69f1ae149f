"""Sinks: nested documents, indexes, append-only logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import at_path


def write_documents(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_reverse_index(edges: DataFrame, folder: str) -> None:
    """One row a target with its incoming edges in order, as parquet; a hub's list is as long as its in-degree."""
    index = edges.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("src", "kind", "via", "where", "confidence"))).alias("incoming"))
    index.write.mode("overwrite").parquet(folder)


def append_events(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_table(df: DataFrame, folder: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(folder)


# ---- writes that leave alone what did not change


def digests(df: DataFrame, *by: str) -> DataFrame:
    """by, n and two sums: what tells a partition's rows from others, whatever their order; copies count."""
    each = [F.xxhash64(F.lit(k), *[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(df.columns)]) for k in (0, 1)]
    parts = [F.sum(F.shiftright(h, 24).cast("decimal(38,0)")).alias(f"d{k}") for k, h in enumerate(each)]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *parts)


def changes(new: DataFrame, old: DataFrame | None, *by: str) -> DataFrame:
    """by, what (added, changed, removed) of the partitions whose digests differ."""
    if old is None:
        return new.select(*by, F.lit("added").alias("what"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    on = same[0]
    for x in same[1:]:
        on = on & x
    both = new.withColumn("here", F.lit(True)).alias("a").join(old.withColumn("here", F.lit(True)).alias("b"), on, "full")
    differs = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.d0").eqNullSafe(F.col("b.d0")) & F.col("a.d1").eqNullSafe(F.col("b.d1")))
    what = F.when(F.col("b.here").isNull(), "added").when(F.col("a.here").isNull(), "removed").when(differs, "changed")
    return both.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in by], what.alias("what")).where("what IS NOT NULL")


def _pointer(spark: SparkSession, folder: str) -> dict | None:
    where, system = at_path(spark, f"{folder}/_current")
    if not system.exists(where):
        return None
    return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(system.open(where), "UTF-8"))


def read_current(spark: SparkSession, folder: str) -> DataFrame | None:
    """What write_changed last finished writing to a folder; None if nothing was."""
    now = _pointer(spark, folder)
    if now is None or not now["parts"]:
        return None
    return spark.read.schema(now["schema"]).option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/{p}" for p in now["parts"]]).drop("_version", "_part")


def write_changed(df: DataFrame, folder: str, *by: str) -> DataFrame:
    """Writes only the partitions (by) whose rows differ from those in folder; by, what of the changes.

    Digests of the partitions, one row each, are joined with those of the version that `_current` points at. Changed partitions go to
    folders of their own, beside the old ones; then the digests, and at last `_current` is replaced by one rename. A reader therefore sees the old
    version or the new one, and a job that dies leaves the old. Without a change no file is written. The driver handles one name a partition.
    """
    spark = df.sparkSession
    now = _pointer(spark, folder)
    new = digests(df, *by)
    old = spark.read.parquet(f"{folder}/_digests/{now['digests']}") if now else None
    found = changes(new, old, *by)
    rows = [r.asDict() for r in found.collect()]
    schema = found.schema
    out = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
    if not rows:
        return out
    name = uuid.uuid4().hex
    key = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__null__"))) for c in by])
    keyed = df.withColumn("_part", F.substring(F.sha2(key, 256), 1, 24))
    wanted = found.where("what <> 'removed'").select(F.substring(F.sha2(key, 256), 1, 24).alias("_part"))
    keyed.join(wanted, "_part", "left_semi").withColumn("_version", F.lit(name)).write.mode("append").partitionBy("_version", "_part").parquet(f"{folder}/data")
    new.write.parquet(f"{folder}/_digests/{name}")
    touched = {r._part: r.what for r in found.select(F.substring(F.sha2(key, 256), 1, 24).alias("_part"), "what").collect()}
    kept = [p for p in (now["parts"] if now else []) if p.rpartition("_part=")[2] not in touched]
    parts = kept + [f"_version={name}/_part={p}" for p, what in touched.items() if what != "removed"]
    text = json.dumps({"digests": name, "parts": sorted(parts), "schema": df.schema.toDDL()})
    at, system = at_path(spark, f"{folder}/_next-{name}")
    stream = system.create(at)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    to, _ = at_path(spark, f"{folder}/_current")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    over = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context.rename(at, to, options)
    return out
