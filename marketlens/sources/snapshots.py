"""Snapshot tables: dated results of earlier fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketlens import schemas
from marketlens.functions.urls import snapshot_key
from marketlens.operators.snapshots import latest
from marketlens.session import file_system, materialize
from marketlens.sources import commits

BROKEN = "_broken"


def read_snapshots(
    spark: SparkSession, path: str, multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Snapshots kept as JSON documents, and the text of broken ones (`document`).

    A document is a whole file, however it is laid out; with `multi_line` false it is a
    line.
    """
    schema = StructType([*schemas.SNAPSHOT.fields, StructField(BROKEN, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    rows = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", schema, options).alias("_d"), F.col("value").alias("document"))
    whole = parsed.where(F.col(f"_d.{BROKEN}").isNull()).select(*[f"_d.{c}" for c in schemas.SNAPSHOT.names])
    key = F.coalesce("cache_key", snapshot_key(F.col("cache_type"), F.col("query")))
    broken = parsed.where(F.col(f"_d.{BROKEN}").isNotNull()).select("document")
    return whole.withColumn("cache_key", key), broken


def write_snapshots(results: DataFrame, path: str, as_of: Column) -> str:
    """Adds results (`cache_type`, `query`, `data`), stamped `as_of`, as one batch.

    A batch is a folder of its own and counts once it is whole; nothing is rewritten.
    """
    stamped = results.select(
        "cache_type",
        snapshot_key(F.col("cache_type"), F.col("query")).alias("cache_key"),
        "query",
        as_of.alias("cached_at"),
        "data",
    )
    batch = commits.new_version()
    stamped.write.mode("errorifexists").parquet(f"{path}/{_DELTA}/{batch}")
    return batch


_DELTA, _BASE = "delta", "base"


def _whole(spark: SparkSession, path: str, batch: str) -> bool:
    system, done = file_system(spark, f"{path}/{_DELTA}/{batch}/_SUCCESS")
    return system.exists(done)


def _parts(spark: SparkSession, path: str, table: dict) -> tuple[list[str], list[str]]:
    """Folders of the base, and batches that are whole and not yet merged into it."""
    base = [f"{path}/{_BASE}/{version}/bucket={b}" for b, version in table["buckets"].items()]
    merged = set(table["merged"])
    batches = [b for b in commits.folders(spark, f"{path}/{_DELTA}") if b not in merged and _whole(spark, path, b)]
    return base, batches


def _table(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, table = commits.current(spark, path)
    return number, table or {"buckets": {}, "merged": [], "count": None}


def read_snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    """Base and batches since: at least the latest snapshot of every key.

    History that was compacted is one row a key, so a reader pays for the keys and for
    the batches since, not for all that was ever written.
    """
    base, batches = _parts(spark, path, _table(spark, path)[1])
    folders = base + [f"{path}/{_DELTA}/{b}" for b in batches]
    if not folders:
        return spark.createDataFrame([], schemas.SNAPSHOT)
    return spark.read.schema(schemas.SNAPSHOT).parquet(*folders)


def compact_snapshots(spark: SparkSession, path: str, buckets: int = 64) -> int:
    """Merges the batches into the base: one row a key; gives how many were merged.

    Keys fall into hash buckets, and only buckets that the batches touch are written
    again, as new folders that a commit names; buckets without news stay as they are.  The
    number of buckets is that of the first compaction.  Readers follow the commit, so a
    compaction that fails changes nothing; of two at a time the later one gives up.
    """
    number, table = _table(spark, path)
    base, batches = _parts(spark, path, table)
    if not batches:
        return 0
    count = table["count"] or buckets
    bucket = F.pmod(F.xxhash64("cache_type", "cache_key"), F.lit(count)).cast("int")
    news = latest(spark.read.schema(schemas.SNAPSHOT).parquet(*[f"{path}/{_DELTA}/{b}" for b in batches]))
    news = materialize(news.withColumn("_bucket", bucket), "snapshot-news")
    touched = sorted(r[0] for r in news.select("_bucket").distinct().collect())  # `count` at most
    before = [f"{path}/{_BASE}/{table['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in table["buckets"]]
    rows = news.drop("_bucket")
    if before:
        rows = latest(rows.unionByName(spark.read.schema(schemas.SNAPSHOT).parquet(*before)))
    version = commits.new_version()
    rows.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/{_BASE}/{version}")
    now = table["buckets"] | {str(b): version for b in touched}
    gone = [b for b in table["merged"] if b in set(commits.folders(spark, f"{path}/{_DELTA}"))]
    if not commits.commit(spark, path, number, {"buckets": now, "merged": gone + batches, "count": count}):
        commits.remove(spark, f"{path}/{_BASE}/{version}")
        return 0
    # what the commit before does not name either has no reader any more
    held = commits.earlier(spark, path)
    versions = {v for c in held for v in c["buckets"].values()}
    for folder in commits.folders(spark, f"{path}/{_BASE}"):
        if folder not in versions:
            commits.remove(spark, f"{path}/{_BASE}/{folder}")
    for batch in gone:
        commits.remove(spark, f"{path}/{_DELTA}/{batch}")
    return len(batches)
