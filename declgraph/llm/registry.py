"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, common, main_text, near_duplicates, neighbours, packing, passages, phrases, privacy, quality, token_shards, toxicity, url_rules, wu_manber
from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-shards")
    token_shards.write_shards(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_shards.read_spans(spark, path)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_read(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(_read(spark, sf_dir, "documents"))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


#: The rules of the registered query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.spans(_read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in privacy.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(privacy.digest("base"), 256).alias("base_sha256"), privacy.digest("all").alias("spans"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that a classifier never learns from: a fifth by crc32 of the id as text; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)) == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link(_read(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels").where(~held_out()))
    return quality.judge(docs, model, ["doc_id"])


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"), k=16, rounds=3, dimension=64, scale=64).drop("met_exactly")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"pipeline": corpus_pipeline.run}
    return found | {f.__name__: f for f in (op1_token_shards, op2_main_text, op3_passages, op4_wu_manber, op5_url_rules, op6_privacy, op7_toxicity, op8_packing, op9_near_duplicates, op10_neighbours, op11_quality, op12_centroids, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
