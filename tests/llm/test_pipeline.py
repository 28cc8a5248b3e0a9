"""Stages of the pipeline, each against its operator's own brute-force rules."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import toxicity
from tests.llm.test_mixing import plain as plain_mixture
from tests.llm.test_simhash import plain_classes, plain_fingerprint
from tests.llm.test_decontamination import brute
from marketlens.llm import decontamination, mixing

SF = "/root/testdata/sf0.001"


def brute_pipeline(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect())
    memo = toxicity.WordHashes()
    order = {r.doc_id: r.o for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("o")).collect()}
    known = sorted((d for d in docs if d[0] in labels), key=lambda d: (order[d[0]], str(d[0])))
    model = toxicity.ftrl([toxicity.features(d[1], memo) for d in known], np.array([labels[d[0]] for d in known], float), toxicity.Settings())
    dense = model.dense()
    docs = [d for d in docs if model.bias + dense[toxicity.features(d[1], memo)].sum() < 0]
    yield {d[0] for d in docs}
    classes, least = plain_classes([plain_fingerprint(d[1]) for d in docs]), {}
    for c, d in zip(classes, docs):
        least[c] = min(least.get(c, d[0]), d[0])
    docs = [d for d in docs if d[0] in set(least.values())]
    yield {d[0] for d in docs}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in brute(items, docs, decontamination.Rule())}
    docs = [d for d in docs if d[0] not in bad]
    yield {d[0] for d in docs}
    rows, _ = plain_mixture(docs, mixing.Targets())
    kept = {int(r[0]) for r in rows if r[4]}
    docs = [d for d in docs if d[0] in kept]
    yield {d[0] for d in docs}
    yield {(d[0], len(d[1].encode()) + 8, zlib.crc32(d[1].encode())) for d in docs}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, final = docs.columns, None
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_pipeline(spark)):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and len(rows) == len(want) and {r.doc_id for r in rows} == want, name
        else:
            assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == want
            final = sorted((r.doc_id, r.shard, r.slot) for r in rows)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.shard, r.slot) for r in got.collect()) == final


def test_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, None, "a", None), (3, "some words of text here", "en", "b", 23)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        step = table.withColumn("doc_id_copy", F.col("doc_id"))
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, str(tmp_path))
        got = step.collect()
        assert len(got) == len({r.slot for r in got if r.shard == 0}) + sum(r.shard > 0 for r in got)
