"""Substring lookup by an inverted index: terms by the three-letter pieces they are made of.

A term's pieces are the three characters from each of its places on, in lower case, and the shorter ends that are left. So a
text of three characters or more is looked up by the rarest of its own pieces, a shorter one by the pieces that begin with it;
terms lie beside their pieces, so what is found is confirmed without another join. Nulls and empty terms have no pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
#: Found terms up to this number are pushed into the scan of their rows as a list; more are joined.
FEW = 1000


def _cut(low: Column, last: Column) -> Column:
    """The distinct pieces that start from place 1 to last; none where last is below 1."""
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    return F.array_distinct(F.transform(places, lambda k: F.substring(low, k, F.lit(SIZE))))


def posted(terms: DataFrame, term: str = "term") -> DataFrame:
    """(piece, term), each once."""
    low = F.lower("term")
    return terms.select(F.col(term).alias("term")).distinct().select(F.explode(_cut(low, F.length(low))).alias("piece"), "term")


def counted(found: DataFrame) -> DataFrame:
    """(piece, n): how many terms have a piece."""
    return found.groupBy("piece").agg(F.count("*").alias("n"))


def holding(needles: DataFrame, found: DataFrame, counts: DataFrame, needle: str = "needle") -> DataFrame:
    """(needle, term), each once: the terms that hold a needle, in any case. Null and empty needles are not looked up.

    Every join has an equality: a needle meets the terms of its rarest piece, a needle of one or two characters those of the
    pieces that begin with it."""
    asked = needles.select(F.col(needle).alias("needle")).where(F.length("needle") > 0).distinct().withColumn("low", F.lower("needle"))
    size = F.length("low")
    long = asked.where(size >= SIZE).select("needle", "low", F.explode(_cut(F.col("low"), size - (SIZE - 1))).alias("piece"))
    rarest = F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece")
    keyed = long.join(counts, "piece", "left").groupBy("needle", "low").agg(rarest)
    met = keyed.join(found, "piece").where(F.lower("term").contains(F.col("low"))).select("needle", "term")
    for n in range(1, SIZE):
        of = found.select(F.substring("piece", 1, n).alias("low"), "term").where(F.length("low") == n).distinct()
        met = met.unionByName(asked.where(size == n).join(of, "low").select("needle", "term"))
    return met


def write(rows: DataFrame, folder: str, term: str = "term") -> None:
    """The index of rows by a column of theirs, as tables under folder: rows in order of term, pieces in order, and their
    counts. So a scan for one piece or a few terms skips all but their places in the files."""
    rows.repartitionByRange(term).sortWithinPartitions(term).write.parquet(f"{folder}/rows")
    spark = rows.sparkSession
    found = posted(spark.read.schema(rows.schema).parquet(f"{folder}/rows"), term)
    found.repartitionByRange("piece", "term").sortWithinPartitions("piece", "term").write.parquet(f"{folder}/pieces")
    written = spark.read.schema("piece string, term string").parquet(f"{folder}/pieces")
    counted(written).repartitionByRange("piece").sortWithinPartitions("piece").write.parquet(f"{folder}/counts")


def terms_with(spark: SparkSession, folder: str, needle: str) -> DataFrame:
    """term: the terms of a written index that hold needle, in any case."""
    low = needle.lower()
    found = spark.read.schema("piece string, term string").parquet(f"{folder}/pieces")
    if len(low) < SIZE:
        return found.where(F.col("piece").startswith(low)).select("term").distinct()
    own = {low[k : k + SIZE] for k in range(len(low) - SIZE + 1)}
    counts = spark.read.schema("piece string, n long").parquet(f"{folder}/counts").where(F.col("piece").isin(*own)).collect()  # no more than needle has
    if len(counts) < len(own):
        return found.where(F.lit(False)).select("term")
    rarest = min((r.n, r.piece) for r in counts)[1]
    return found.where((F.col("piece") == rarest) & F.lower("term").contains(low)).select("term")


def search(spark: SparkSession, folder: str, needle: str, schema: str, term: str = "term") -> DataFrame:
    """Rows of a written index (of this schema) whose term holds needle, in any case; an empty needle is held by all terms
    that are not empty."""
    terms = terms_with(spark, folder, needle)
    few = [r.term for r in terms.limit(FEW + 1).collect()]
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    if len(few) <= FEW:
        return rows.where(F.col(term).isin(*few)) if few else rows.where(F.lit(False))
    return rows.join(terms.withColumnRenamed("term", term), term, "left_semi")
