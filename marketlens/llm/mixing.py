"""Mixing sources to target weights by iterative proportional fitting.

Built-in functions only.  Token sums by (source, language, topic) are raked in turn to
the three target marginals until all hold; a document is then sampled with its cell's
calibrated probability, by a hash of its id, so that a rerun takes the same documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.session import materialize

DIMENSIONS = ("source", "lang", "topic")
CHECK_ROUNDS = 4


@dataclass(frozen=True)
class Targets:
    """Target of a value: its token share to the power `exponents`, at most `boost` times the share, normalised.

    An exponent of 1 keeps the marginal as it is, 0 makes it even.  Every value, however
    rare, and null too, has a target of its own.  `share`: share of all tokens that the
    sample is expected to hold; None: the most that takes no document twice.
    """

    exponents: tuple[float, float, float] = (0.5, 0.7, 0.7)
    boost: float = 4.0
    share: float | None = None
    tolerance: float = 1e-9
    max_rounds: int = 60
    seed: int = 42


def surface_topic(text: Column) -> Column:
    """Topic by surface: figures, symbols, brief (under 100 words) or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    figures = F.regexp_count(text, F.lit("[0-9]")) / size
    symbols = F.regexp_count(text, F.lit("[#$%&*=<>{}|_]")) / size
    return (
        F.when(figures >= 0.03, "figures")
        .when(symbols >= 0.03, "symbols")
        .when(F.length(text) < 600, "brief")
        .otherwise("prose")
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")).cast("long")


def _joined(df: DataFrame, other: DataFrame, names, how: str = "inner") -> DataFrame:
    """Join on dimensions in which null equals null."""
    named = other.select(*[F.col(n).alias(f"_{n}") if n in names else F.col(n) for n in other.columns])
    return df.join(named, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names], how).drop(*[f"_{n}" for n in names])


def _total(df: DataFrame, value: Column) -> float:
    """One number: the sum of a value over a table, 0 of an empty one."""
    return float(df.agg(F.sum(value)).first()[0] or 0)


def _goals(cells: DataFrame, name: str, power: float, boost: float) -> DataFrame:
    """Target share of each value of a dimension."""
    sums = materialize(cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t")), f"shares-{name}")
    own = F.col("t") / F.lit(_total(sums, F.col("t")))
    raw = F.pow(own, F.lit(power))
    low = F.least(raw / F.lit(_total(sums, raw)), own * F.lit(boost))
    return sums.select(name, (low / F.lit(_total(sums, low))).alias(f"goal_{name}"))


def rake(cells: DataFrame, targets: Targets) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their fitted weight `w`, whose marginals are the targets.

    Cells stay a distributed table: each step sums the weights of a dimension's values
    and joins the sums back, so a value with a third of all cells is no single task's.
    Every round is written, which keeps plans short and survives lost executors.
    """
    some = cells.filter("tokens > 0")
    now = some.withColumn("w", F.col("tokens") / F.lit(_total(some, F.col("tokens"))))
    for name, power in zip(DIMENSIONS, targets.exponents):
        now = _joined(now, _goals(some, name, power, targets.boost), [name])
    now = materialize(now, "cells")
    for done in range(1, targets.max_rounds + 1):
        for name in DIMENSIONS:
            # the table is named twice here, so plans double with every step: a round is written
            sums = now.groupBy(name).agg(F.sum("w").alias("_sum"))
            now = _joined(now, sums, [name]).withColumn("w", F.col("w") * F.col(f"goal_{name}") / F.col("_sum")).drop("_sum")
        now = materialize(now, "raked")
        if done % CHECK_ROUNDS == 0:
            off = [
                now.groupBy(n).agg(F.abs(F.sum("w") - F.max(f"goal_{n}")).alias("gap")).select("gap") for n in DIMENSIONS[:2]
            ]  # topics were fitted last
            worst = off[0].union(off[1]).agg(F.max("gap")).first()[0]
            if worst is None or worst < targets.tolerance:
                break
    return now


def _uniform(id_col: str, seed: int) -> Column:
    """Number in [0, 1) from an id; null ids share one."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def probabilities(rows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """source, lang, topic, probability of the cells of rows that have n_tokens.

    Probabilities are in proportion to fitted over own weight and never cut, so the
    sample's marginals are the targets in expectation.  The level is that at which the
    largest is 1, or the sample holds the share of tokens that the targets name; then a
    document is taken as often as the whole of its probability says, and once more by
    the rest.
    """
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "raw-cells")
    total = _total(cells, F.col("tokens"))
    fitted = rake(cells, targets).withColumn("ratio", F.col("w") / F.col("tokens"))
    if targets.share is None:
        level = 1 / (fitted.agg(F.max("ratio")).first()[0] or 1.0)
    else:
        level = targets.share * total
    chances = fitted.select(*DIMENSIONS, (F.col("ratio") * F.lit(level)).alias("probability"))
    return materialize(chances, "probabilities")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        "source",
        "lang",
        surface_topic(text).alias("topic"),
        word_count(text).alias("n_tokens"),
    )


def _placed(rows: DataFrame, chances: DataFrame, seed: int) -> DataFrame:
    """Rows with probability and copies; cells without tokens are taken whole, once."""
    placed = _joined(rows, chances, DIMENSIONS, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    sure = F.floor("probability")
    more = _uniform("doc_id", seed) < F.col("probability") - sure
    return placed.withColumn("copies", (sure + more.cast("long")).cast("int"))


def mix(df: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, copies, kept for every row.

    Null is a source or language like any other.  A null text has no tokens and stays
    like any other of its cell; cells without tokens stay whole.  Rows with one id share
    one fate.  An empty table gives no rows.
    """
    rows = materialize(measured(df, id_col, text_col), "measured")
    return _placed(rows, probabilities(rows, targets), targets.seed).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "copies", (F.col("copies") > 0).alias("kept")
    )


def sample(df: DataFrame, targets: Targets = Targets(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df that `mix` keeps, as many times as it says, all columns as they are."""
    rows = materialize(measured(df, id_col, text_col), "measured")
    chances = probabilities(rows, targets)
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = df.select(
        F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), "source", "lang", surface_topic(text).alias("topic")
    )
    kept = _placed(thin, chances, targets.seed).filter("copies > 0")
    if targets.share is None:
        return kept.select("row.*")
    return kept.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
