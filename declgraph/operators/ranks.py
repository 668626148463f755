"""Ranked reports: nearest-rank percentiles, concentration, top lists, pages, the deepest rung within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(value: str, p: float) -> Column:
    """Nearest rank, max(1, ceil(n * p)); null over nothing."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


#: How far around the wanted share two bounds are taken, and the accuracy of the sketch that gives them: its error, one part
#: in so many, is far smaller.
NEAR, ACCURACY = 0.001, 10_000
#: How many equal steps the values between the bounds are dealt to, each of which is put in order by itself.
STEPS = 256


def concentration(df: DataFrame, value: str, share: float, name: str = "share") -> DataFrame:
    """One row: the part of the sum that the largest max(1, ceil(n * share)) values hold; 0 if the sum is 0.

    A quantile sketch gives two bounds around the smallest of these values. What is above both is added up by an aggregate;
    the few values between the bounds are dealt to steps, whose totals (one row a step) tell how many values come before each,
    and are put in order step by step."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    ends = F.array(*(F.lit(min(1.0, max(0.0, 1 - share + step))) for step in (-NEAR, NEAR)))
    one = v.agg(F.count("*").alias("rows"), F.sum("v").alias("sum"), F.percentile_approx("v", ends, F.lit(ACCURACY)).alias("b"))
    one = one.select("sum", F.greatest(F.lit(1), F.ceil(F.col("rows") * share)).alias("most"), F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    held = v.crossJoin(F.broadcast(one)).where("v >= low")  # one row
    low, width = F.col("low").cast("double"), F.col("high").cast("double") - F.col("low").cast("double")
    step = F.when(F.col("v") > F.col("high"), STEPS + 1).when(width > 0, F.floor((F.col("v").cast("double") - low) / width * STEPS)).otherwise(0).cast("int")
    counts = held.groupBy(step.alias("step"), F.when(F.col("v") <= F.col("high"), F.col("v")).alias("v")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.first("most").alias("most"), F.first("sum").alias("sum"))
    totals = counts.groupBy("step").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("step", "n")).alias("t"))  # a row a step
    above = lambda x: F.aggregate(F.filter("t", lambda y: y["step"] > x["step"]), F.lit(0).cast("long"), lambda acc, y: acc + y["n"])
    before = totals.select(F.explode(F.transform("t", lambda x: F.struct(x["step"].alias("step"), above(x).alias("before")))).alias("b")).select("b.*")
    w = Window.partitionBy("step").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("most") - F.col("before") - F.coalesce(F.sum("n").over(w), F.lit(0))
    placed = counts.join(F.broadcast(before), "step").withColumn("taken", F.greatest(F.lit(0), F.least(F.col("n"), left)))
    parts = placed.select(F.when(F.col("v").isNull(), F.col("s")).otherwise(F.col("v") * F.col("taken")).alias("part"), "sum")
    return parts.agg(F.sum("part").alias("part"), F.first("sum").alias("sum")).select(F.when(F.coalesce("sum", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("part") / F.col("sum")).cast("double").alias(name))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def after(df: DataFrame, last: dict[str, object], limit: int) -> DataFrame:
    """The page that follows a row in ascending order of columns (nulls first): last has the values of that row's columns, in
    order of the columns. The first page is that of `page`.

    The first column's bound is a filter of its own, which a scan of a sorted table meets with its statistics, so a late page
    reads as much as an early one. The columns should tell every row apart; rows equal to last in all of them are skipped."""
    # a time without zone goes as text, so that no zone is read into it
    held = lambda c, v: F.lit(str(v)).cast("timestamp_ntz") if df.schema[c].dataType.typeName() == "timestamp_ntz" else F.lit(v)
    later = lambda c, v: F.col(c).isNotNull() if v is None else F.col(c) > held(c, v)
    same = lambda c, v: F.col(c).isNull() if v is None else F.col(c) == held(c, v)
    columns = list(last)
    beyond = F.lit(False)
    for c in reversed(columns):
        beyond = later(c, last[c]) | (same(c, last[c]) & beyond)
    head = columns[0]
    rows = df if last[head] is None else df.where(F.col(head) >= held(head, last[head]))
    return rows.where(beyond).orderBy(*columns).limit(limit)


def deepest_within(rungs: DataFrame, budget: int) -> DataFrame:
    """The largest level whose bytes are within the budget; 0 if none is."""
    return rungs.agg(F.coalesce(F.max(F.when(F.col("bytes") <= budget, F.col("level"))), F.lit(0)).alias("level"))


def tests_last(df: DataFrame, is_test: Column, *order: Column | str) -> DataFrame:
    return df.orderBy(is_test, *order)
