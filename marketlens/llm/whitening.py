"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Vectors become integers, so counts, sums and deviations are exact.  Spark sums the
centred scatter over all rows (d x d numbers a task, merged by key); the scatter is
factored by Cholesky with diagonal pivots, and Jacobi rotations make the columns of the
triangular factor orthogonal.  Their squared lengths are the eigenvalues and the columns,
scaled to length one, the eigenvectors; the product of the factor with itself is never
formed again, which keeps small eigenvalues exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from marketlens.session import materialize, ship_package

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**40  # entries beyond this after scaling do not fit exact sums
MAX_DIMENSION = 4096  # bounds the matrix on the driver (128 MB)
BLOCK_VALUES = 1 << 21
LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """Counts and exact sums of the fit list, eigenvectors in columns, falling eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Factor f with matrix = f @ f.T, its columns in order of falling pivots.

    Rows are those of the matrix; in the order of the pivots the factor is lower
    triangular.  It has one column for each pivot above rounding (the numerical rank).
    """
    rest = np.diag(matrix).astype(float).copy()
    least = len(matrix) * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    columns: list[np.ndarray] = []
    factor = np.zeros((len(matrix), len(matrix)))
    open_rows = np.ones(len(matrix), bool)
    while open_rows.any():
        pivot = int(np.argmax(np.where(open_rows, rest, -np.inf)))
        if not rest[pivot] > least:
            break
        k = len(columns)
        column = matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        column = np.where(open_rows, column, 0.0) / np.sqrt(rest[pivot])
        column[pivot] = np.sqrt(rest[pivot])
        factor[:, k] = column
        columns.append(column)
        rest = rest - column**2
        open_rows[pivot] = False
    return factor[:, : len(columns)]


def _rounds(n: int):
    """Pairings of n columns in which each pair meets once, as a tournament."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]) if max(a, b) < n]
        yield np.array(pairs, np.int64).reshape(-1, 2).T
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times a rotation that makes its columns orthogonal to double precision."""
    f = factor.copy()
    least = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for a, b in _rounds(f.shape[1]):
            if not len(a):
                continue
            x, y = f[:, a], f[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            some = np.abs(xy) > least * np.sqrt(xx * yy)
            if not some.any():
                continue
            turned = True
            zeta = (yy - xx) / np.where(some, 2 * xy, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(some, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            f[:, a], f[:, b] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return f


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit eigenvectors in columns."""
    turned = jacobi_columns(pivoted_cholesky(scatter))
    values = (turned * turned).sum(0)
    order = np.argsort(-values, kind="stable")
    values, turned = values[order], turned[:, order]
    some = values > 0
    return values[some], turned[:, some] / np.sqrt(values[some])


def _scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lists as floor(1024 c) + 100000, where lists start, lengths of whole ones (else 0)."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values)
        bad = ~(np.abs(scaled) < LARGEST)
    lengths = np.diff(offsets).astype(np.int64)
    wrong = np.r_[0, np.cumsum(bad)]
    lengths[(wrong[offsets[1:]] > wrong[offsets[:-1]]) | column.is_null().to_numpy(zero_copy_only=False)] = 0
    scaled[bad] = 0
    return scaled.astype(np.int64) + SHIFT, offsets[:-1], lengths


def _blocks(column: pa.Array, width: int):
    """(rows, integer vectors) of the whole vectors of one length, a bounded block at a time."""
    values, starts, lengths = _scaled(column)
    rows = np.flatnonzero(lengths == width)
    step = max(1, BLOCK_VALUES // width)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        yield part, values[starts[part][:, None] + np.arange(width)]


def exact_sums(df: DataFrame, vector_col: str) -> tuple[int, list[int]]:
    """Number and exact sums of the vectors of the commonest length (ties: the longest).

    Tasks send a sum for each position and length; entries that are null or not finite
    leave a vector out.
    """

    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            for width in np.unique(_scaled(column)[2]).tolist():
                if not width:
                    continue
                if width > MAX_DIMENSION:
                    raise ValueError(f"a vector has {width} entries, more than {MAX_DIMENSION}")
                kept = totals.setdefault(width, [0, np.zeros(width, object)])
                for rows, x in _blocks(column, width):
                    kept[0] += len(rows)
                    kept[1] = kept[1] + x.sum(0).astype(object)
        for width, (n, sums) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([width] * width, pa.int32()),
                    pa.array(range(width), pa.int32()),
                    pa.array([n] * width, pa.int64()),
                    pa.array([str(s) for s in sums]),
                ],
                names=["width", "position", "n", "total"],
            )

    parts = df.select(F.col(vector_col).alias("v")).mapInArrow(run, "width int, position int, n long, total string")
    summed = materialize(
        parts.groupBy("width", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("s")),
        "vector-sums",
    )
    best = summed.filter("position = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        return 0, []
    rows = summed.filter(F.col("width") == best["width"]).orderBy("position").collect()  # one a dimension
    return best["n"], [int(r["s"]) for r in rows]


def _scatter(df: DataFrame, width: int, centred_blocks) -> np.ndarray:
    """Sum of products of all pairs of columns of the blocks, over all tasks."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for c in centred_blocks(batch.column(0)):
                total += c.T @ c
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array((i * width + j).astype(np.int32)), pa.array(total[i, j])], names=["cell", "value"]
        )

    cells = df.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((width, width))
    for cell, value in cells:
        out[cell // width, cell % width] = out[cell % width, cell // width] = value
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they hold it, Python integers otherwise."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit(df: DataFrame, vector_col: str = "embedding") -> Whitening:
    """Whitening of all usable vectors of df; see `whiten` for the cases."""
    ship_package()
    n, sums = exact_sums(df, vector_col)
    width = len(sums)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)

    def centred(column):
        for _, x in _blocks(column, width):
            yield _deviations(x, n, sums).astype(np.float64) / n

    scatter = _scatter(df.select(F.col(vector_col).alias("v")), width, centred)
    values, components = eigen(scatter)
    return Whitening(n, sums, components, values / n, float(np.trace(scatter)) / n)


def transform(
    df: DataFrame, model: Whitening, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, deviation, whitened (array, one entry a component) of every usable vector."""
    ship_package()
    n, sums, width = model.n, model.sums, len(model.sums)
    kept = min(components, len(model.eigenvalues))
    scaled = model.components[:, :kept] / np.sqrt(model.eigenvalues[:kept])
    schema = T.StructType(
        [
            T.StructField("vec_id", df.schema[id_col].dataType),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches):
        for batch in batches:
            for rows, x in _blocks(batch.column(1), width) if width else ():
                m = _deviations(x, n, sums)
                if int(np.abs(m).max(initial=0)) ** 2 * width >= LONG:
                    m = m.astype(object)
                squares = (m * m).sum(1)
                w = (m.astype(np.float64) / n) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array([int(s) if s < LONG else None for s in squares.tolist()], pa.int64()),
                        pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * kept, pa.array(w.ravel())),
                    ],
                    names=["vec_id", "deviation", "whitened"],
                )

    return df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def identity_error(whitened: DataFrame, width: int, n: int, column: str = "whitened") -> float:
    """Largest entry of the covariance of whitened vectors minus the identity."""
    if not width:
        return 0.0

    def blocks(lists):
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        step = max(1, BLOCK_VALUES // width)
        for at in range(0, len(values), step):
            yield values[at : at + step]

    means = whitened.select([F.avg(F.col(column)[i]) for i in range(width)]).first()
    centre = np.array(list(means), float)
    cov = _scatter(whitened.select(column), width, lambda lists: (b - centre for b in blocks(lists))) / n
    return float(np.abs(cov - np.eye(width)).max())


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; a row a vector and component.

    Vectors that are null or empty or hold null or non-finite entries (or entries beyond
    2^30, whose integers do not fit exact sums) are left out; so are those of another
    length than the commonest (ties: the longest).  Longer vectors than MAX_DIMENSION are
    refused.  Repeated rows and null ids count and appear like any other.  Components
    without variance do not exist: fewer are given, none for equal vectors or an empty
    table.  Equal eigenvalues leave their order to rounding.  A deviation beyond 64 bits
    is null.  Other columns are not read.
    """
    model = fit(df, vector_col)
    kept = min(components, len(model.eigenvalues))
    rows = materialize(transform(df, model, components, id_col, vector_col), "whitened")
    error = identity_error(rows, kept, model.n)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:kept]]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
