"""Shards along a Hilbert curve over metadata dimensions.

Built-in functions only.  Each dimension is quantised to cells, the cells' place on the
curve orders the rows, and the ordered rows are cut into runs of equal counts.  A run
covers a compact region in every dimension, so min/max statistics of its files prune
on any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import materialize

BITS = 5


def _rotated(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for every state (direction * 2^n + entry) and cell of a cube.

    States follow the published compact form of the curve: entry point and direction
    of each sub-cube along the Gray code.
    """
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}

    def entry(w: int) -> int:
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def trailing(w: int) -> int:
        return next(k for k in range(n + 1) if not (w >> k) & 1)

    def direction(w: int) -> int:
        if w == 0:
            return 0
        return trailing(w - 1) % n if w % 2 == 0 else trailing(w) % n

    digits, states = [], []
    for d in range(n):
        for e in range(size):
            for cell in range(size):
                w = rank[_rotated(cell ^ e, n - (d + 1), n)]
                digits.append(w)
                e2 = e ^ _rotated(entry(w), d + 1, n)
                d2 = (d + direction(w) + 1) % n
                states.append(d2 * size + e2)
    return digits, states


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of a cell (one integer of `bits` bits a dimension)."""
    n = len(cells)
    digits, states = curve_tables(n)
    table = F.array(*[F.lit(s * (1 << n) + w) for w, s in zip(digits, states)])  # both in one look-up
    coordinates = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, level: Column) -> Column:
        parts = [
            F.call_function("shiftleft", F.call_function("shiftright", coordinates[i], level).bitwiseAND(F.lit(1)), F.lit(i))
            for i in range(n)
        ]
        cell = reduce(lambda a, b: a.bitwiseOR(b), parts)
        found = F.element_at(table, (acc["s"] * (1 << n) + cell + 1).cast("int"))
        return F.struct(
            F.call_function("shiftright", found, F.lit(n)).cast("int").alias("s"),
            (acc["h"] * (1 << n) + found % (1 << n)).cast("long").alias("h"),
        )

    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


def numbered(df: DataFrame, dimensions: list[str], names: list[str]) -> DataFrame:
    """Adds a number for each dimension, in the order of its values; null for null.

    Values of a text are numbered by their full order: the distinct ones are sorted over
    all tasks and take the places they have there, so values that begin alike differ.
    """
    kinds = dict(df.dtypes)
    for c, name in zip(dimensions, names):
        if kinds[c] != "string":
            df = df.withColumn(name, F.col(c).cast("double"))
            continue
        value = f"{name}_value"
        values = df.select(F.col(c).alias(value)).filter(F.col(value).isNotNull()).distinct()
        in_order = values.repartitionByRange(value).sortWithinPartitions(value)
        places = materialize(in_order.select(value, F.monotonically_increasing_id().cast("double").alias(name)), "values-in-order")
        df = df.join(places, F.col(c) == F.col(value), "left").drop(value)
    return df


def cell_of(number: Column, bounds: list[float]) -> Column:
    """Cells 1 to n by how many bounds lie below the number; 0 for null."""
    if not bounds:
        return F.when(number.isNull(), F.lit(0)).otherwise(F.lit(1))
    below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < number))
    return F.when(number.isNull(), F.lit(0)).otherwise(below + 1)


def curve_order(df: DataFrame, numbers: list[str], bits: int = BITS) -> Column:
    """Curve index of each row; bounds are quantiles over all rows (2^bits - 2 a dimension)."""
    shares = [i / ((1 << bits) - 1) for i in range(1, (1 << bits) - 1)]
    row = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
    return hilbert_index([cell_of(F.col(c), sorted(set(row[f"q{i}"] or []))) for i, c in enumerate(numbers)], bits)


def shard(
    df: DataFrame,
    shards: int = 24,
    dimensions: tuple[str, ...] = ("source", "lang", "n_chars"),
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot for every row.

    size: UTF-8 bytes of the text (null: none) and 8; text_crc32 of a null text is that
    of an empty one.  Shards are consecutive runs of the curve whose row counts are at
    most one apart; slot counts from 0 within a shard in curve order.  Rows of one cell
    are ordered by text checksum, id and source, so a cell with a third of all rows is cut like
    any other and copies of a text lie together.  Repeated rows get a slot each, null
    ids and null dimensions come first, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbers = [f"dim_{i}" for i in range(len(dimensions))]
    thin = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(c).alias(f"of_{i}") for i, c in enumerate(dimensions)],
    )
    values = [f"of_{i}" for i in range(len(dimensions))]
    thin = materialize(numbered(materialize(thin, "shard-values"), values, numbers).drop(*values), "shard-keys")
    index = curve_order(thin, numbers, bits)
    keys = ["curve", "text_crc32", "doc_id", *numbers]
    placed = materialize(
        thin.withColumn("curve", index)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("at", F.monotonically_increasing_id()),
        "shard-order",
    )
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row a partition of the sort: bounded by the number of partitions
    offsets = counts.select(
        "part",
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
        F.sum("n").over(everything).alias("total"),
    )
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    small, more = F.expr(f"total div {shards}"), F.col("total") % shards
    wide = (small + 1) * more  # rows in the shards that hold one more
    return (
        placed.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn("rank", rank)
        .withColumn("small", small)
        .withColumn("more", more)
        .withColumn("wide", wide)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "curve",
            F.expr("CASE WHEN rank < wide THEN rank div (small + 1) ELSE more + (rank - wide) div small END")
            .cast("int")
            .alias("shard"),
            F.expr("CASE WHEN rank < wide THEN rank % (small + 1) ELSE (rank - wide) % small END")
            .cast("long")
            .alias("slot"),
        )
    )


def write_shards(df: DataFrame, path: str, shards: int = 24, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"),
                 bits: int = BITS) -> DataFrame:
    """Writes whole rows as Parquet in curve order, a range of the curve a file.

    Gives the manifest: for each file the least and greatest value of every dimension.
    """
    own = "_curve" + "_" * max(map(len, df.columns), default=0)  # no column of df has this name
    numbers = [f"{own}_{i}" for i in range(len(dimensions))]
    known = materialize(numbered(df, list(dimensions), numbers), "shard-rows")
    ordered = known.withColumn(own, curve_order(known, numbers, bits)).repartitionByRange(
        shards, own, *dimensions, F.xxhash64(*df.columns)
    )
    ordered.sortWithinPartitions(own, *dimensions).select(*df.columns).write.parquet(path)
    stats = [f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("least", F.min), ("most", F.max))]
    return df.sparkSession.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_rows"), *stats)
