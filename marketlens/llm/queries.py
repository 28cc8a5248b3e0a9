"""Registered queries of the training-data operators (and of the pipeline)."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import byte_bpe, decontamination, language, licences, mixing, oracles, sharding, simhash, spelling, tokens, topk, toxicity, whitening
from marketlens.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_license_scan", oracles.licence_scan())
def op1(spark, sf_dir):
    found = licences.notices(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence", F.round("score", 6).alias("score"), "unit")


@query("op2_hilbert_shards")
def op2(spark, sf_dir):
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


@query("op3_simhash_near_dedup")
def op3(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_mixture", oracles.mixture())
def op4(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("probability", F.round("probability", 6))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    profiles = language.learn(docs.filter(~held_out))
    found = language.predict(docs, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_decontamination")
def op6(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "common", "answer", "at_word")


@query("op7_exact_top_k", oracles.TOP_K)
def op7(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, scale=1024)


@query("op8_token_counts")
def op8(spark, sf_dir):
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op9_token_id_files")
def op9(spark, sf_dir):
    path = tokens.write_token_ids(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("word_bpe_49k.json"),
        scratch_path(spark, "token-ids"),
        end_id=2,
    )
    return tokens.token_offsets(tokens.read_token_ids(spark, path))


def _toxicity_model(spark, sf_dir, docs):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(_remainder(5) != 0)
    return toxicity.train(docs, labels)


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, _toxicity_model(spark, sf_dir, docs))
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_byte_bpe")
def op12(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode_parts(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
