"""Requested parts from CSV, form rows or memory."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens import schemas
from marketlens.functions import text
from marketlens.operators.parts import is_complete, with_default_keywords

REQUIRED_COLUMNS = ["part_id", "part_name", "keywords"]


def scan_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text.  `multi_line` allows line breaks in quoted cells but
    keeps a file in one task, so it is off unless asked for."""
    return spark.read.csv(
        path, header=True, inferSchema=False, encoding="UTF-8", multiLine=multi_line,
        quote='"', escape='"',
    )


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(REQUIRED_COLUMNS) - set(df.columns))


def is_valid_input(df: DataFrame) -> bool:
    """Required columns are there, and at least one row."""
    return not missing_columns(df) and not df.isEmpty()


def _trimmed(df: DataFrame, name: str) -> Column:
    return text.strip(text.or_empty(F.col(name))) if name in df.columns else F.lit("")


def with_row_number(df: DataFrame) -> DataFrame:
    """Adds `row_number`, 1-based, in file order.

    Rows are numbered inside each file split in parallel; only one count per
    split goes through the ordered window that turns them into offsets.
    """
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    ordered = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        placed.groupBy("_file", "_start")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(ordered), F.lit(0)))
        .drop("_rows")
    )
    return (
        placed.join(splits, ["_file", "_start"])
        .withColumn("row_number", F.col("_id") - F.col("_first") + F.col("_before") + 1)
        .drop("_file", "_start", "_id", "_first", "_before")
    )


def read_parts(
    spark: SparkSession, path: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Complete parts of a CSV file, and its rejected rows.

    An id that is no whole number rejects its row, not the file.
    """
    raw = with_row_number(scan_csv(spark, path, multi_line))
    number = text.normalize_digits(_trimmed(raw, "part_id")).try_cast("bigint")
    rows = raw.select(
        number.cast("string").alias("part_id"),
        (F.col("row_number") - 1).alias("part_ord"),
        *[_trimmed(raw, c).alias(c) for c in ("part_name", "part_code", "keywords")],
    )
    return rows.where(is_complete()), rows.where(~is_complete())


def read_parts_lenient(
    spark: SparkSession, path: str, stamp: str, multi_line: bool = False
) -> DataFrame:
    """Ids made from row numbers, blank keywords filled in from the name."""
    raw = with_row_number(scan_csv(spark, path, multi_line))
    rows = raw.select(
        F.concat(
            F.lit("part_"), F.col("row_number").cast("string"), F.lit(f"_{stamp}")
        ).alias("part_id"),
        (F.col("row_number") - 1).alias("part_ord"),
        *[_trimmed(raw, c).alias(c) for c in ("part_name", "part_code", "keywords")],
    )
    return with_default_keywords(rows)


def parts_from_rows(spark: SparkSession, rows: Iterable[Mapping | Sequence]) -> DataFrame:
    """Parts held in memory: mappings with the part fields, in order."""
    fields = ("part_name", "part_code", "keywords")
    data = [
        (str(r["part_id"]), i, *[(r.get(f) or "") for f in fields]) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, schemas.PART)
