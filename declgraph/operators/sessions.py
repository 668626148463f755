"""Reads of one target after another: pairs within a gap, and statistics by command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentile

GAP_SECONDS = 120


def rereads(events: DataFrame, target: str, label: Column, at: Column, order: list[str], gap: float = GAP_SECONDS) -> DataFrame:
    """before, after, n: a target read again within the gap by another label, in log order; pairs counted."""
    w = Window.partitionBy(target).orderBy(*order)
    rows = events.where(F.col(target).isNotNull()).withColumn("label", label).withColumn("at", at).where("at is not null")
    rows = rows.withColumn("before", F.lag("label").over(w)).withColumn("since", F.col("at") - F.lag("at").over(w))
    return rows.where((F.col("before") != F.col("label")) & F.col("since").between(0, gap)).groupBy("before", F.col("label").alias("after")).agg(F.count("*").alias("n"))


def command_stats(events: DataFrame, command: str, failed: Column, millis: str) -> DataFrame:
    """By command: calls, failed, p50 and p90 of the milliseconds."""
    return events.groupBy(F.col(command).alias("command")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"), percentile(millis, 0.5).alias("p50"), percentile(millis, 0.9).alias("p90"))
