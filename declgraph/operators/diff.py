"""Differences of two snapshots: file states, counters, declaration changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import normal_access


def file_states(disk: DataFrame, index: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """path and state: fresh, modified, missing (in the index only) or unindexed (on disk only)."""
    d = disk.select(F.col(path).alias("path"), F.col(digest).alias("now"))
    i = index.select(F.col(path).alias("path"), F.col(digest).alias("then"))
    state = F.when(F.col("then").isNull(), "unindexed").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("then"), "fresh").otherwise("modified")
    return d.join(i, "path", "full_outer").select("path", state.alias("state"))


def index_counters(states: DataFrame, full: bool = False) -> DataFrame:
    """One row: files added, updated, skipped and removed by a run."""
    s = F.col("state")
    updated = (s == "modified") | ((s == "fresh") & F.lit(full))
    return states.agg(F.count_if(s == "unindexed").alias("added"), F.count_if(updated).alias("updated"), F.count_if((s == "fresh") & ~F.lit(full)).alias("skipped"), F.count_if(s == "missing").alias("removed"))


def changes(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """path, decl_id, change (added, removed, signature, body), access, lines.

    old and new have path, decl_id, signature, access and ordinal; of equal ids the old side keeps the first and the new
    side the last. A declaration on both sides is reported if its signature differs or touched (path, decl_id, lines) has it.
    """
    def of(df: DataFrame, side: str, pick) -> DataFrame:
        value = pick(F.struct("ordinal", "signature", "access")).alias("v")
        return df.groupBy("path", "decl_id").agg(value).select("path", "decl_id", F.col("v.signature").alias(f"{side}_signature"), F.col("v.access").alias(f"{side}_access"), F.lit(True).alias(side))

    both = of(old, "old", F.min).join(of(new, "new", F.max), ["path", "decl_id"], "full_outer")
    if touched is not None:
        both = both.join(touched.select("path", "decl_id", "lines"), ["path", "decl_id"], "left")
    else:
        both = both.withColumn("lines", F.lit(None).cast("long"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "signature").when(F.coalesce("lines", F.lit(0)) > 0, "body")
    return both.select("path", "decl_id", change.alias("change"), normal_access(F.coalesce("new_access", "old_access")).alias("access"), F.coalesce("lines", F.lit(0)).alias("lines")).where("change is not null")


def delta_totals(found: DataFrame) -> DataFrame:
    """One row of counts by change, of public interface, and of files."""
    open_to_all = F.col("access").isin("public", "open")
    kinds = [F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "signature", "body")]
    return found.agg(F.count_distinct("path").alias("files_changed"), *kinds, F.count_if((F.col("change") == "added") & open_to_all).alias("api_added"), F.count_if((F.col("change") == "removed") & open_to_all).alias("api_removed"))
