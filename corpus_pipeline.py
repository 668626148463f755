"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a frame with the columns of documents, the last one packed pieces. Other
columns of docs, whatever their names, are not read and go no further. A null in any column is kept: a document without text has
none of what a stage looks for, one without id is a document of its own. Equal rows are judged alike; an empty table gives an
empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declgraph.llm import common, near_duplicates, packing, privacy, toxicity, wu_manber

#: Ids of dropped documents up to this number (8 bytes each) are broadcast to the texts; more are joined by shuffle.
MOST_BROADCAST = 2_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


_tables: list[str] = []


def stage(f: Callable) -> Callable:
    """A stage's result is written before the next stage begins, so its intermediate tables can go then, and so can what the
    driver still holds of it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.remove(spark, _tables)
        common.give_back()
        common.free(spark)
        with common.written() as tables:
            out = f(spark, docs, sf_dir)
        _tables[:] = tables
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not call toxic (score under 0.5). Null and empty texts score as
    texts without any feature. Without labels of both classes the score is the share of toxic labels, 0.5 without labels at all:
    then nothing is dropped."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights.any():
        return docs.select(*COLUMNS)
    return toxicity.score(docs.select(*COLUMNS), model, COLUMNS).where("score < 0.5").select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without id are kept; rows of one id stay or go together. Documents without words are no copies of each other."""
    gone = common.materialize(near_duplicates.link(docs).where("doc_id is not null and not kept").select("doc_id").distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    return docs.select(*COLUMNS).join(side, "doc_id", "left_anti").select(*COLUMNS)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. An empty benchmark, or one of null texts, drops none."""
    found = wu_manber.scan(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where(F.size("starts") == 0).select(*COLUMNS)


@stage
def sanitise_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and disclosing terms generalised or removed; n_chars is the new length. A null text stays null, and so does its n_chars."""
    return privacy.sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, chunks=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("privacy", sanitise_private),
    ("packing", pack),
]

#: A trained classifier, signatures and a genetic algorithm are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{common.unique()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
