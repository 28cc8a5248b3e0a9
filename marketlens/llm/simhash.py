"""SimHash near-duplicates by an inverted index on byte positions.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most
three bits share at least 8 - 3 = 5 of them (the guaranteed minimum of matches).
Posting lists of single bytes would hold 1/256 of all rows each, so that tallies a
pair would grow with the square of the table.  The index therefore has one posting
list for each set of five positional bytes: a pair that shares t bytes stands in
C(t, 5) of them, so standing in any list *is* the count filter, and the rest fall out
without being paired.  Within a list the bytes that a pair shares are tallied and pairs with
the guaranteed minimum are verified by their differing bits; in long lists members are
looked up by the bits that may differ, all together, so a hot list takes time in
proportion to its members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from marketlens.llm.components import connected_components
from marketlens.session import materialize, ship_package

SHINGLE = 3
MAX_BITS = 3
BLOCK_WORDS = 1 << 16
PAIRWISE = 1024  # members of longer posting lists are looked up instead of compared
BYTES = 8


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 (seed 42) of the word shingles, as unsigned.

    A-Z are lower-cased, words lie between ASCII white space; fewer words than `size`
    make one shingle, no word gives 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    bits = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
    width = min(size, len(words))
    total, counts = len(words) - width + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, BLOCK_WORDS):
        block = words[at : at + BLOCK_WORDS + width - 1]
        joined = b" ".join(block)
        ends = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(block) - width + 1].tolist(), ends[width - 1 :].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:z], 42) for a, z in spans]), np.uint8).reshape(-1, 8)
        counts += np.concatenate([np.bincount(hashes[:, k], minlength=256) @ bits for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of all members after the members a are joined with the members b, and which pairs did it.

    The smallest member is the root; each pair that is named joins two trees.
    """
    used, left = [], np.arange(len(a))
    while True:
        ra, rb = parent[a[left]], parent[b[left]]
        left, ra, rb = left[ra != rb], ra[ra != rb], rb[ra != rb]
        if not len(left):
            return parent, np.concatenate(used) if used else left
        high, one = np.unique(np.maximum(ra, rb), return_index=True)
        parent[high] = np.minimum(ra, rb)[one]
        used.append(left[one])
        while True:
            onward = parent[parent]
            if (onward == parent).all():
                break
            parent = onward


def _linked_pairwise(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Short lists: tally the bytes that a member shares with each unseen one, keep the least number, verify bits."""
    n = len(values)
    seen, edges = np.zeros(n, bool), []
    for first in range(n):
        if seen[first]:
            continue
        seen[first] = True
        front = [first]
        while front:
            i = front.pop()
            rest = np.flatnonzero(~seen)
            differing = values[rest] ^ values[i]
            shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)
            rest, differing = rest[shared >= BYTES - max_bits], differing[shared >= BYTES - max_bits]
            near = rest[np.bitwise_count(differing) <= max_bits]
            seen[near] = True
            edges.append(np.stack([np.full(len(near), values[i]), values[near]], 1))
            front += near.tolist()
    return np.concatenate(edges)


def _linked_by_flips(values: np.ndarray, max_bits: int) -> np.ndarray:
    """Long lists: all members are looked up together, once for each way to flip the bits in which they differ."""
    n = len(values)
    free = int(np.bitwise_or.reduce(values ^ values[0]))
    ones = [b for b in range(64) if (free >> b) & 1]
    places = None
    if len(ones) <= 8 * MAX_BITS:  # three free bytes: a table of 2^24 places (64 MB at most)
        short = np.zeros(n, np.uint32)
        for k, b in enumerate(ones):
            short |= ((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint32) << np.uint32(k)
        places = np.full(1 << len(ones), -1, np.int32)
        places[short] = np.arange(n, dtype=np.int32)
    parent, edges = np.arange(n), [np.zeros((0, 2), np.uint64)]
    for count in range(1, max_bits + 1):
        for bits in combinations(range(len(ones)), count):
            if places is not None:
                at = places[short ^ np.uint32(sum(1 << k for k in bits))]
                here = np.flatnonzero(at > np.arange(n))
                there = at[here]
            else:
                wanted = values ^ np.uint64(sum(1 << ones[k] for k in bits))
                at = np.minimum(np.searchsorted(values, wanted), n - 1)
                here = np.flatnonzero((values[at] == wanted) & (at > np.arange(n)))
                there = at[here]
            parent, used = _merge(parent, here, there)
            edges.append(np.stack([values[here[used]], values[there[used]]], 1))
    return np.concatenate(edges)


def spanning_links(values: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Edges that connect what is connected by links of at most `max_bits` bits.

    `values`: sorted distinct uint64.  The two ways differ in speed alone.
    """
    if not len(values):
        return np.zeros((0, 2), np.uint64)
    return (_linked_pairwise if len(values) <= PAIRWISE else _linked_by_flips)(values, max_bits)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (XXH64 of the whole text), fp (as signed long)."""
    ship_package()
    schema = T.StructType(
        [
            T.StructField("doc_id", df.schema[id_col].dataType),
            T.StructField("text_hash", T.LongType()),
            T.StructField("fp", T.LongType()),
        ]
    )

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(fps)], names=["doc_id", "text_hash", "fp"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, schema)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, distinct) that join all linked ones.

    A list of five fixed bytes has at most 2^24 members (128 MB), whatever the table
    holds; it gives fewer edges than members, so copies are never expanded into pairs.
    """
    ship_package()
    masks = []
    for kept in combinations(range(BYTES), BYTES - MAX_BITS):
        mask = sum(0xFF << (8 * k) for k in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    posted = distinct.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("list", "shared")
    )
    by = Window.partitionBy("list", "shared").orderBy("fp")
    neighbours = (
        posted.select("list", "shared", "fp", F.lag("fp").over(by).alias("p"), F.lead("fp").over(by).alias("n"))
        .filter("p IS NOT NULL OR n IS NOT NULL")
        .select("list", "shared", "fp")
    )

    def run(batches):
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rest = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            if not len(rest):
                continue
            new = np.flatnonzero(np.any(rest[1:, :2] != rest[:-1, :2], 1)) + 1
            cut = new[-1] if len(new) else 0
            yield from links_of(rest[:cut])
            rest = rest[cut:]
        yield from links_of(rest)

    def links_of(rows):
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, np.any(rows[1:, :2] != rows[:-1, :2], 1)])
        values = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
        out = [spanning_links(np.sort(values[a:b])) for a, b in zip(starts, np.r_[starts[1:], len(rows)])]
        edges = np.concatenate(out).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    rows = neighbours.select(F.col("list").cast("long"), "shared", "fp")
    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, root (fingerprint of its class), component_id for every row.

    component_id is the smallest id of the class; ids that are null take no part in
    that minimum (a class of null ids alone has null).  Null, empty and blank texts have fingerprint 0 and link
    like any other.  Repeated rows stay, in one class.  An empty table gives no rows.
    """
    prints = materialize(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(distinct.select("fp")))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    classes = materialize(classes, "simhash-classes")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    members = classes.select("fp", "root").join(named, "root")
    return prints.join(members, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df, one for each class: that of the smallest id (null ids last).

    Of rows with that id the one with the smallest text hash stays; of repeated rows, one.
    """
    found = near_duplicates(df, id_col, text_col)
    first = F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    kept = found.groupBy("root").agg(first.alias("k")).select(
        F.col("k.doc_id").alias("_kept_id"), F.col("k.text_hash").alias("_kept_hash")
    )
    hashed = "_row_hash" + "_" * max(map(len, df.columns), default=0)  # no column of df has this name
    rows = df.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    matched = rows.join(
        kept, rows[id_col].eqNullSafe(kept["_kept_id"]) & (rows[hashed] == kept["_kept_hash"]), "left_semi"
    )
    return matched.dropDuplicates([id_col, hashed]).select(*df.columns)
