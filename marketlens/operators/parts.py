"""Requested parts: completeness, field checks, metadata."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import classify, fixed_values as fv, text


def is_complete() -> Column:
    """An id (not 0), a name and keywords."""
    part_id = F.col("part_id").cast("string")
    return (
        ~F.coalesce(part_id, F.lit("")).isin("", "0")
        & (text.or_empty(F.col("part_name")) != "")
        & (text.or_empty(F.col("keywords")) != "")
    )


def complete_parts(parts: DataFrame) -> DataFrame:
    return parts.where(is_complete())


def named_parts(parts: DataFrame) -> DataFrame:
    """Form rows: only the name is required."""
    return parts.where(text.strip(text.or_empty(F.col("part_name"))) != "")


def with_field_checks(parts: DataFrame) -> DataFrame:
    size = lambda name: F.length(text.strip(text.or_empty(F.col(name))))
    return parts.withColumns(
        {
            "valid_name": size("part_name") >= 2,
            "valid_code": (text.or_empty(F.col("part_code")) == "") | (size("part_code") >= 2),
            "valid_keywords": size("keywords") >= 2,
        }
    )


def split_valid(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts that pass all field checks, and the others with the three flags."""
    checked = with_field_checks(parts)
    passes = F.col("valid_name") & F.col("valid_code") & F.col("valid_keywords")
    return (
        checked.where(passes).drop("valid_name", "valid_code", "valid_keywords"),
        checked.where(~passes),
    )


def with_default_keywords(parts: DataFrame) -> DataFrame:
    return parts.withColumn(
        "keywords", text.default_keywords(F.col("keywords"), F.col("part_name"))
    )


def with_metadata(
    parts: DataFrame, lexicons: Mapping[str, classify.Lexicon] = classify.PART_LEXICONS
) -> DataFrame:
    """Adds the seven metadata columns (`part_name_norm` is the display name).

    A missing name gives UNKNOWN throughout, whatever the code says.  The text is
    prepared once and each feature becomes a column before it is used again,
    which keeps the generated code small.
    """
    blank = text.or_empty(F.col("part_name")) == ""
    features = {
        name: F.when(blank, fv.UNKNOWN).otherwise(classify.first_match(F.col("_form"), lexicon))
        for name, lexicon in lexicons.items()
    }
    m = {name: F.col(name) for name in features}
    return (
        parts.withColumn("_text", text.analysis_text(F.col("part_name"), F.col("part_code")))
        .withColumn("_form", F.lower("_text"))
        .withColumns(features)
        .withColumns(
            {
                "part_key": classify.part_key(m["part_type"], m["side"], m["variant"], m["trim"]),
                "part_name_norm": F.when(blank, "").otherwise(
                    classify.part_display_name(m, F.col("_text"), lexicons)
                ),
            }
        )
        .drop("_text", "_form")
    )


def with_extraction_check(parts: DataFrame) -> DataFrame:
    issues = classify.extraction_issues(
        F.col("part_type"), F.col("car_model"), F.col("side"), F.col("trim")
    )
    return parts.withColumn("issues", issues).withColumn(
        "extraction_valid", classify.extraction_is_valid(F.col("issues"))
    )
