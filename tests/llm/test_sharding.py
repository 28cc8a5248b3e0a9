"""Curve and shards against plain versions."""

import math
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from marketlens.llm import sharding


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = list(product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    index = sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)
    by_place = {r.h: tuple(r[i] for i in range(n)) for r in df.withColumn("h", index).collect()}
    assert sorted(by_place) == list(range(len(cells)))
    walk = [by_place[i] for i in range(len(cells))]
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(walk, walk[1:]))


ROWS = [
    (i if i % 50 else None, None if i % 31 == 0 else "tä" * (i % 7), None if i % 41 == 0 else "en", "hot" if i % 3 else f"s{i % 11}", i % 100, "clash", 1)
    for i in range(1000)
] + [(5, "twice", "en", "a", 3, "clash", 1)] * 2
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, curve string, size int"


@pytest.mark.parametrize("count", [1002, 24, 25, 7, 0])
def test_counts_and_slots(spark, count):
    rows = ROWS[-count:] if count else []
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.shard(df.repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append((r.slot, r.curve))
    sizes = [len(slots.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(24))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    walk = [c for s in sorted(slots) for _, c in sorted(slots[s])]
    assert walk == sorted(walk)


def plain_shards(rows, shards=24, bits=sharding.BITS):
    """(doc_id, crc, shard, slot) by sorting all rows; cells from exact ranks, the curve from its tables."""
    digits, states = sharding.curve_tables(3)

    def numbers(k):
        values = sorted({r[k] for r in rows if r[k] is not None})
        return {v: float(i) for i, v in enumerate(values)}

    columns = [(3, numbers(3)), (2, numbers(2)), (4, None)]
    cells = []
    for k, number in columns:
        of = [None if r[k] is None else number[r[k]] if number else float(r[k]) for r in rows]
        known = sorted(x for x in of if x is not None)
        parts = (1 << bits) - 1
        bounds = sorted({known[max(0, math.ceil(len(known) * i / parts) - 1)] for i in range(1, parts)}) if known else []
        cells.append([0 if x is None else 1 + sum(b < x for b in bounds) for x in of])
    out = []
    for row, cell in zip(rows, zip(*cells)):
        state, place = 0, 0
        for level in range(bits - 1, -1, -1):
            at = sum(((c >> level) & 1) << i for i, c in enumerate(cell))
            state, place = states[state * 8 + at], place * 8 + digits[state * 8 + at]
        crc = zlib.crc32((row[1] or "").encode())
        out.append((place, crc, (row[0] is not None, row[0] or 0), row[3], row[0], crc))
    out.sort(key=lambda o: o[:4])
    small, more = divmod(len(rows), shards)
    sizes = [small + (k < more) for k in range(shards)]
    slots = [(k, i) for k, size in enumerate(sizes) for i in range(size)]
    return sorted(((o[4] or 0, o[5], *slot) for o, slot in zip(out, slots)))


def test_order_equals_plain_sort(spark):
    got = sharding.shard(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text_crc32, r.shard, r.slot) for r in got) == plain_shards(ROWS)


def test_sources_that_begin_alike_have_cells_of_their_own(spark):
    rows = [(i, "t", "en", f"https://site{i % 30:02d}.example", 1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len({r.curve for r in sharding.shard(df).collect()}) > 10


def test_written_shards_keep_all_columns(spark, tmp_path):
    rows = [(i, "t", "en", f"s{i % 3}", i, i * 2) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _curve long")
    sharding.write_shards(df, str(tmp_path / "shards"), 4)
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert written.columns == df.columns and sorted(map(tuple, written.collect())) == rows


def test_written_shards_prune(spark, tmp_path):
    rows = [(i, "t", "en" if i % 2 else "de", f"s{i % 16:02d}", i) for i in range(4096)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = sharding.write_shards(df, str(tmp_path / "shards"), 16).collect()
    assert sum(r.n_rows for r in manifest) == 4096
    touched = [r for r in manifest if r.least_source <= "s03" <= r.most_source and r.least_n_chars <= 100 <= r.most_n_chars]
    assert 1 <= len(touched) <= len(manifest) // 2
