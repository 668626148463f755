"""Churn from version control: totals by file, time buckets, last change, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import percentile


def churn(log: DataFrame, path: str = "path", author: str = "author", commit: str = "commit", at: str = "at", insertions: str = "insertions", deletions: str = "deletions") -> DataFrame:
    """By path: commits (each once), authors, insertions, deletions, last_change."""
    return log.groupBy(F.col(path).alias("path")).agg(F.count_distinct(commit).alias("commits"), F.count_distinct(author).alias("authors"), F.sum(insertions).alias("insertions"), F.sum(deletions).alias("deletions"), F.max(at).alias("last_change"))


def bucket(at: Column, start: Column, width: Column, buckets: int) -> Column:
    """Number of an equal-width bucket, held within 0 to buckets - 1."""
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), F.floor((at - start) / width))).cast("int")


def sparkline(log: DataFrame, key: str, bucket_col: str, buckets: int) -> DataFrame:
    """key and series: events in each bucket, zeros included."""
    counts = log.groupBy(key, bucket_col).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(bucket_col, "n"))).alias("m"))
    return counts.select(key, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0).cast("long"))).alias("series"))


def last_touched(log: DataFrame, path: str = "path", at: str = "at") -> DataFrame:
    return log.groupBy(path).agg(F.max(at).alias("touched"))


def days_since(at: Column, now: Column) -> Column:
    return ((now - at) / 86400).cast("int")


def flags(churned: Column, declarations: Column, coverage: Column, directives: Column, age: Column, threshold: Column) -> Column:
    """hot, thin-docs, unmapped, dormant and review, in this order."""
    # fixed values: a quarter covered, a year untouched
    hot, thin = (churned >= threshold) & (churned > 0), (declarations > 0) & (coverage < 0.25)
    named = ((hot, "hot"), (thin, "thin-docs"), (directives == 0, "unmapped"), (age > 365, "dormant"), (hot & thin, "review"))
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))


def hot_threshold(files: DataFrame, churned: str = "churn") -> DataFrame:
    """One row: the third quartile of positive churn, 1 at least."""
    return files.where(F.col(churned) > 0).agg(F.greatest(F.lit(1), F.coalesce(percentile(churned, 0.75), F.lit(1))).alias("threshold"))
