"""Exact top-k by inner product with a pivot table.

For a query q, a vector x and any pivot p the triangle inequality gives
|q - x| >= | |q - p| - |x - p| |.  The greatest of these lower bounds over all pivots
bounds the inner product from above: q.x <= (|q|^2 + |x|^2 - bound^2) / 2.  Distances
to the pivots are computed once and stored with the vectors.  Candidates are evaluated
in the order of their bounds until no bound reaches the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from marketlens.session import materialize, ship_package

PIVOTS = 48
SEEDS = 1024  # vectors that give each query a first k-th score
QUERY_BYTES = 8 << 20  # queries broadcast at a time
CHUNK = 4096  # vectors bounded at a time
STEP = 256  # vectors evaluated between two looks at the stopping rule

INDEX = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("vector", T.BinaryType()),
        T.StructField("distances", T.BinaryType()),
    ]
)


def quantised(df: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (floor(scale * x) of every component, as double) of every row.

    Vectors that are null, empty or hold null or non-finite components are left out,
    like null ids.
    """
    x = F.transform(vector_col, lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).filter(good)
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("v"),
    )


def _array(values, dtype=np.float64) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype) for v in values])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each pivot is the sample's vector farthest from those taken before."""
    taken, least = [], np.full(len(sample), np.inf)
    at = 0
    for _ in range(min(count, len(sample))):
        taken.append(at)
        least = np.minimum(least, _distances(sample, sample[at : at + 1])[:, 0])
        at = int(least.argmax())
    return sample[taken]


def pivot_table(vectors: DataFrame, chosen: dict[int, np.ndarray]) -> DataFrame:
    """Vectors with their distances to the pivots chosen for their length, as bytes of doubles."""
    ship_package()

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                x = np.stack(part["v"].to_numpy()).astype(np.float64)
                d = _distances(x, chosen[dim]) if dim in chosen else np.zeros((len(x), 0))
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(),
                        "row": part["row"].to_numpy(),
                        "dim": np.full(len(x), dim, np.int32),
                        "vector": [r.tobytes() for r in x],
                        "distances": [r.tobytes() for r in d],
                    }
                )

    return vectors.mapInPandas(run, INDEX)


def _best(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_chunk(q_row, q, q_dist, floor, ids, rows, x, x_dist, k):
    """The k best of one chunk for one query: ids and scores.

    `q_row`: number of the query's own row, which is no candidate.  `floor`: a score that k vectors of the whole table reach; lower ones are of no use.
    """
    other = rows != q_row
    lower = np.abs(x_dist - q_dist).max(1) if x_dist.shape[1] else np.zeros(len(ids))
    norm = (x * x).sum(1) + (q * q).sum()
    # a margin for the rounding of roots; bounds only ever get weaker by it
    upper = (norm - np.maximum(lower - 1e-6 * (1 + lower), 0) ** 2) / 2 + 1e-6 * norm + 1
    order = np.flatnonzero(other & (upper >= floor))
    order = order[np.argsort(-upper[order], kind="stable")]
    best_ids, best = np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(order), STEP):
        limit = max(floor, best[-1] if len(best) == k else -np.inf)
        part = order[at : at + STEP]
        if upper[part[0]] < limit:
            break
        scores = x[part] @ q
        best_ids, best = _best(np.concatenate([best_ids, ids[part]]), np.concatenate([best, scores]), k)
    useful = best >= floor
    return best_ids[useful], best[useful]


def exact_top_k(
    df: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, pivots: int = PIVOTS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    `queries` are rows of df.  Every row of the query's length but its own is a candidate,
    so of rows with its id and vector all but one; ties go to the smaller id.  Rows that
    are repeated are candidates each, and queries each.  Scores are exact while they stay
    below 2^53.  Queries are taken in blocks of `QUERY_BYTES`, each block against all rows.
    Pivots and first scores come from at most `SEEDS` vectors of each length; they decide
    how much is evaluated, never what is found.  Empty tables give no rows.
    """
    ship_package()
    spark = df.sparkSession
    numbered = quantised(df, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id())
    vectors = materialize(numbered, "vectors")
    once = quantised(queries, scale, id_col, vector_col).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    rows = vectors.select(F.col("vec_id").alias("_id"), F.col("v").alias("_v"), "row")
    asked = (
        once.join(rows, (F.col("vec_id") == F.col("_id")) & (F.col("v") == F.col("_v")), "left")
        .groupBy("vec_id", "v", "times")
        .agg(F.coalesce(F.min("row"), F.lit(-1)).alias("own"))
    )
    asked = materialize(asked.withColumn("dim", F.size("v")).withColumn("query", F.monotonically_increasing_id()), "queries")
    hashed = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "row")
    # SEEDS rows a length: ranked within tasks before they meet
    sample = (
        vectors.withColumn("dim", F.size("v")).withColumn("n", F.row_number().over(hashed)).filter(F.col("n") <= SEEDS)
    )
    seeds: dict[int, list] = {}
    for row in sample.collect():
        seeds.setdefault(row["dim"], []).append((row["row"], row["v"]))
    first = {
        dim: (np.array([i for i, _ in found], np.int64), np.array([v for _, v in found], np.float64))
        for dim, found in seeds.items()
    }
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = {dim: spread_pivots(x, pivots) for dim, (_, x) in first.items()}
    index = materialize(pivot_table(vectors, chosen), "pivots")
    per_block = max(1, QUERY_BYTES // (8 * (max(first) + pivots + 2)))
    sizes = asked.groupBy(F.shiftright("query", 33).alias("p")).count().orderBy("p").collect()
    found = None
    for row in sizes:
        for start in range(0, row["count"], per_block):
            low = (row["p"] << 33) + start
            part = asked.filter((F.col("query") >= low) & (F.col("query") < low + per_block) & (F.shiftright("query", 33) == row["p"]))
            block = _prepared([(r["query"], r["own"], r["dim"], r["v"]) for r in part.collect()], first, chosen, k)
            some = _search(spark, index, block, k)
            found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    named = asked.select("query", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.col("times"))))
    return best.join(named, "query").select("query_id", "rank", "vec_id", "score")


def _prepared(rows, first, chosen, k):
    """By length: numbers, own rows, vectors, distances to the pivots, first k-th scores of a block."""
    block = {}
    for dim in {r[2] for r in rows} & first.keys():
        mine = [r for r in rows if r[2] == dim]
        numbers, own = (np.array([r[i] for r in mine], np.int64) for i in (0, 1))
        q = np.array([r[3] for r in mine], np.float64)
        seed_rows, x = first[dim]
        scores = np.where(own[:, None] == seed_rows[None], -np.inf, q @ x.T)
        floor = -np.sort(-scores, 1)[:, k - 1] if len(seed_rows) >= k else np.full(len(q), -np.inf)
        block[dim] = (numbers, own, q, _distances(q, chosen[dim]), floor)
    return block


def _search(spark, index: DataFrame, block: dict, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(block)

    def run(frames):
        best: dict[int, tuple] = {}
        for frame in frames:
            for start in range(0, len(frame), CHUNK):
                piece = frame.iloc[start : start + CHUNK]
                for dim, part in piece.groupby("dim"):
                    if dim not in shared.value:
                        continue
                    ids, rows, x = part["vec_id"].to_numpy(), part["row"].to_numpy(), _array(part["vector"])
                    x_dist = _array(part["distances"])
                    for number, own, q, q_dist, floor in zip(*shared.value[dim]):
                        known = best.get(number)
                        limit = max(floor, known[1][-1]) if known and len(known[1]) == k else floor
                        got = search_chunk(own, q, q_dist, limit, ids, rows, x, x_dist, k)
                        if len(got[0]):
                            both = [np.concatenate(c) for c in zip(known, got)] if known else got
                            best[number] = _best(both[0], both[1], k)
        for number, (ids, scores) in best.items():
            yield pd.DataFrame({"query": number, "vec_id": ids, "score": scores.astype(np.int64)})

    return index.mapInPandas(run, "query long, vec_id long, score long")
