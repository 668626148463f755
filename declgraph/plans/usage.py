"""Reports over the usage log: commands, refused arguments, repeated reads, a listing that can be replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import invocations as inv
from ..operators import ranks

# Entries of a ranked list, and seconds within which a second read counts as a repeated one.
LIST_CAP, REPEAT_SECONDS = 10, 120


def calls(events: DataFrame) -> DataFrame:
    """Events (seq, at, argv, status, ms) whose arguments are a command: with command, depth, target and ok."""
    rows = inv.with_call(events.where("argv is not null"), inv.normalised(F.col("argv")))
    ok = F.coalesce(F.col("status") == "ok", F.lit(True))
    return rows.select("*", F.col("call.command").alias("command"), inv.depth_label(F.col("call")).alias("depth"), inv.target(F.col("call")).alias("target"), ok.alias("ok")).drop("call")


def totals(events: DataFrame) -> DataFrame:
    """One row: invocations, parsed, failed, first and last time (in the order of the log)."""
    rows = events.where("argv is not null")
    known = F.count_if(inv.command_of(inv.normalised(F.col("argv"))).isNotNull())
    failed = F.count_if(F.coalesce(F.col("status") != "ok", F.lit(False)))
    return rows.agg(F.count("*").alias("invocations"), known.alias("parsed"), failed.alias("failed"), F.min_by("timestamp", "seq").alias("first"), F.max_by("timestamp", "seq").alias("last"))


def commands(found: DataFrame) -> DataFrame:
    """By command: count, failed, nearest-rank p50 and p90 of ms, and how often each depth was asked for."""
    depths = found.where("depth is not null").groupBy("command", "depth").agg(F.count("*").alias("n")).groupBy("command").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("depth", "n")))).alias("depth"))
    stats = found.groupBy("command").agg(F.count("*").alias("count"), F.count_if(~F.col("ok")).alias("failed"), ranks.percentile("ms", 0.5).alias("p50_ms"), ranks.percentile("ms", 0.9).alias("p90_ms"))
    return stats.join(depths, "command", "left").orderBy(F.desc("count"), "command")


def usage_errors(found: DataFrame, cap: int = LIST_CAP) -> DataFrame:
    """Arguments that were refused as such, as they were written, most often first."""
    refused = found.where("status = 'exit 64'").select(F.array_join("argv", " ").alias("argv"), "status")
    return ranks.top(refused.groupBy("argv", "status").agg(F.count("*").alias("count")), cap, F.desc("count"), "argv")


def repeated(found: DataFrame, cap: int = LIST_CAP, seconds: int = REPEAT_SECONDS) -> DataFrame:
    """Targets that two different reads, one soon after the other, were aimed at: target, first, then, count.

    Reads of a target are taken in the order of the log; failed ones, and those without a time, are no reads."""
    reads = found.where("ok and target is not null and at is not null").withColumn("label", F.concat_ws(" ", "command", "depth"))
    w = Window.partitionBy("target").orderBy("seq")
    pairs = reads.select("target", F.lag("label").over(w).alias("first"), F.col("label").alias("then"), (F.col("at") - F.lag("at").over(w)).alias("since"))
    pairs = pairs.where((F.col("first") != F.col("then")) & (F.col("since") <= seconds))
    return ranks.top(pairs.groupBy("target", "first", "then").agg(F.count("*").alias("count")), cap, F.desc("count"), "target", "first", "then")


def report(events: DataFrame) -> dict[str, DataFrame]:
    found = calls(events)
    return {"totals": totals(events), "commands": commands(found), "usage_errors": usage_errors(found), "repeated_targets": repeated(found)}


def replay(events: DataFrame, program: str, failed: bool = False) -> DataFrame:
    """seq and line: the log as command lines, oldest first; what failed carries its status as a comment."""
    rows = events.where("argv is not null")
    rows = rows.where(F.coalesce(F.col("status") != "ok", F.lit(True))) if failed else rows
    note = F.when(F.coalesce(F.col("status") == "ok", F.lit(False)), "").otherwise(F.concat(F.lit("  # "), F.coalesce("status", F.lit("?"))))
    return rows.select("seq", F.concat(F.lit(program + " "), inv.quoted(F.col("argv")), note).alias("line")).orderBy("seq")
