"""Resolution ladders: rows of the first rung that any row reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rung(df: DataFrame, *rungs: Column) -> DataFrame:
    """Rows with the smallest rung that fits any row, with `rung` from 0. One pass finds the rung, one keeps its rows."""
    rung = F.coalesce(*(F.when(r, F.lit(k)) for k, r in enumerate(rungs)))
    ranked = df.withColumn("rung", rung).where(F.col("rung").isNotNull())
    best = ranked.agg(F.min("rung").alias("best"))
    return ranked.join(F.broadcast(best), F.col("rung") == F.col("best")).drop("best")  # best is one row


def lookup(decls: DataFrame, query: str) -> DataFrame:
    """For records: exact id; else exact name, or an id that holds the query."""
    return first_rung(decls, F.col("decl_id") == query, (F.col("name") == query) | F.lower("decl_id").contains(query.lower()))


def for_calls(decls: DataFrame, query: str) -> DataFrame:
    """For the call graph: exact id; name in any case; id that holds the query."""
    q = query.lower()
    return first_rung(decls, F.col("decl_id") == query, F.lower("name") == q, F.lower("decl_id").contains(q))


def for_outline(decls: DataFrame, query: str) -> DataFrame:
    """For outlines: exact id; name that holds the query, in any case; id that holds it."""
    q = query.lower()
    return first_rung(decls, F.col("decl_id") == query, F.lower("name").contains(q), F.lower("decl_id").contains(q))


def for_edit(decls: DataFrame, query: str) -> DataFrame:
    """For edits: exact id; else name, or an id or signature that holds the query."""
    q = query.lower()
    return first_rung(decls, F.col("decl_id") == query, (F.col("name") == query) | F.lower("decl_id").contains(q) | F.lower("signature").contains(q))
