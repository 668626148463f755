"""How files change: history joined to the index, flags, and the flat list of entities that a dashboard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import history

SECONDS_A_DAY = 86_400

# The metrics of a dashboard, with unit, which end wants attention, and format.
METRICS = {
    "churn": ("lines", "riskier", "int"),
    "commits": ("commits", "riskier", "int"),
    "authors": ("people", "riskier", "int"),
    "age_days": ("days", "safer", "int"),
    "declarations": ("declarations", "riskier", "int"),
    "doc_coverage": ("ratio", "safer", "percent"),
    "directives": ("directives", "safer", "int"),
    "bytes": ("bytes", "riskier", "bytes"),
    "lines_touched": ("lines", "riskier", "int"),
    "documented": ("boolean", "safer", "bool"),
    "guards": ("directives", "riskier", "int"),
}


def structure(files: DataFrame, decls: DataFrame, docs: DataFrame, directives: DataFrame) -> DataFrame:
    """path, declarations, documented and directives of every file, also of those without any."""
    d = decls.select("id", "file_id")
    documented = d.join(docs.select(F.col("decl_id").alias("id"), F.lit(1).alias("doc")).distinct(), "id", "left").groupBy("file_id").agg(F.count("*").alias("declarations"), F.count("doc").alias("documented"))
    tagged = directives.select(F.col("decl_id").alias("id")).join(d, "id").groupBy("file_id").agg(F.count("*").alias("directives"))
    rows = files.select(F.col("id").alias("file_id"), "path").join(documented, "file_id", "left").join(tagged, "file_id", "left")
    return rows.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("declarations", "documented", "directives")))


def enriched(spine: DataFrame, log: DataFrame, touched: DataFrame, now: float, days: int = 90, buckets: int = 12) -> DataFrame:
    """The files of the index with their history: it adds columns, never rows.

    log has commit, author, at (seconds), path, insertions and deletions of the window; touched has path and touched
    (seconds) over all history. Files of equal churn are ordered by path."""
    start, width = now - days * SECONDS_A_DAY, days * SECONDS_A_DAY / buckets
    totals = history.churn(log)
    series = history.sparkline(log.select("path", "commit", history.bucket(F.col("at"), F.lit(start), F.lit(width), buckets).alias("b")).distinct(), "path", "b", buckets)
    rows = spine.join(totals, "path", "left").join(series, "path", "left").join(touched.select("path", "touched"), "path", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    numbers = {c: count(c) for c in ("commits", "authors", "insertions", "deletions")}
    rows = rows.withColumns(numbers).withColumn("churn", F.col("insertions") + F.col("deletions"))
    rows = rows.withColumn("series", F.coalesce("series", F.array_repeat(F.lit(0).cast("long"), buckets))).withColumn("age_days", history.days_since(F.col("touched"), F.lit(now)))
    rows = rows.withColumn("doc_coverage", F.when(F.col("declarations") > 0, F.col("documented") / F.col("declarations")).otherwise(0.0))
    found = rows.crossJoin(F.broadcast(history.hot_threshold(rows)))  # one row
    flags = history.flags(F.col("churn"), F.col("declarations"), F.col("doc_coverage"), F.col("directives"), F.col("age_days"), F.col("threshold"))
    return found.select("path", "commits", "authors", "insertions", "deletions", "churn", "age_days", "declarations", "doc_coverage", "directives", "series", flags.alias("flags"))


def ranked(files: DataFrame, top: int = 10) -> DataFrame:
    """The files that change most; equal ones by path."""
    return files.orderBy(F.desc("churn"), "path").limit(top)


def totals(spine: DataFrame, log: DataFrame) -> DataFrame:
    """One row: files changed, commits (summed over files) and authors, of files that the index has."""
    held = log.join(spine.select("path"), "path", "left_semi")
    files = history.churn(held).agg(F.count("*").alias("files_changed"), F.coalesce(F.sum("commits"), F.lit(0)).alias("commits"))
    return files.crossJoin(F.broadcast(held.agg(F.count_distinct("author").alias("authors"))))  # one row each


def bucket_label(days: int, buckets: int) -> str:
    return f"{max(1, days // buckets)}d" if buckets else "none"


_VALUES = "map<string,double>"


def _values(*names: str):
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def entities(mass: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """One flat list: id, kind, label, path, line, parent, values (numbers by metric), texts (short words), flags, series.

    mass has path, declarations, bytes; files is `enriched`; changes has path, decl_id, line, change, lines_touched, access,
    kind, documented, guards (array). A file in both lists is one entity."""
    numbers = ("churn", "commits", "authors", "declarations", "doc_coverage", "directives", "age_days")
    both = mass.select("path", _values("declarations", "bytes").alias("m")).join(files.select("path", _values(*numbers).alias("f"), "flags", "series"), "path", "full_outer")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    first, second = F.coalesce("m", none), F.coalesce("f", none)
    merged = F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)
    no_text, no_flags = F.lit(None).cast("map<string,string>"), F.array().cast("array<string>")
    of_file = both.select(
        F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), tx.last_segment(F.col("path")).alias("label"), "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("parent"),
        merged.cast(_VALUES).alias("values"), no_text.alias("texts"), F.coalesce("flags", no_flags).alias("flags"), F.col("series").cast("array<long>").alias("series"),
    )
    c = changes.withColumn("n_guards", F.size("guards"))
    marks = F.array_compact(F.array(F.col("change"), F.when(F.col("n_guards") > 0, "guarded"), F.when(~F.col("documented"), "undocumented")))
    of_change = c.select(
        F.concat(F.lit("decl:"), "decl_id").alias("id"), F.lit("declaration").alias("kind"), tx.before_bracket(F.col("decl_id")).alias("label"), "path", F.col("line").cast("int").alias("line"), F.concat(F.lit("file:"), "path").alias("parent"),
        F.create_map(F.lit("lines_touched"), F.col("lines_touched").cast("double"), F.lit("documented"), F.col("documented").cast("int").cast("double"), F.lit("guards"), F.col("n_guards").cast("double")).cast(_VALUES).alias("values"),
        F.create_map(F.lit("change"), "change", F.lit("access"), "access", F.lit("kind"), "kind").cast("map<string,string>").alias("texts"), marks.alias("flags"), F.lit(None).cast("array<long>").alias("series"),
    )
    return of_file.unionByName(of_change)
