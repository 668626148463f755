"""URL filter: hashed host-suffix and path-prefix expressions joined with a rule table.

A URL is expanded into every host suffix combined with every path prefix that ends in a slash (and the empty one). A rule
is filed under its host and the longest such prefix of its path. Both sides are joined on the first 32 bits of the SHA-256
of that expression; the full digest and the rest of the rule's path are then compared, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are broadcast (about 200 bytes each); more are shuffled, repeated for each salt.
MOST_BROADCAST, SALTS = 200_000, 16


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with digest, 32-bit prefix and precedence. Rules with a null part are left out; of equal
    rules with other verdicts, block wins."""
    anchor = F.regexp_extract("path", "(?s)^(.*/)", 1)
    return (
        rules.select("host", "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
        .select("path", "verdict", F.concat("host", "path").alias("rule"), _digest(F.concat("host", anchor)).alias("digest"), F.size(F.split("host", r"\.")).alias("labels"), (F.size(F.split("path", "/", -1)) - 1).alias("depth"))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row for each row of pages: id, url, host, path, rule (null if none fits) and verdict.

    Null ids and urls, equal rows and empty tables keep their number of rows. A url without rule gets default. Other
    columns of pages are not read. The one shuffle carries a row for each distinct id and url with the best rule so far
    (rules are met before it), so a host that holds a third of all urls gathers nowhere.
    """
    table = prepare_rules(rules)
    n, labels, depth = table.agg(F.count("*"), F.max("labels"), F.max("depth")).first()
    labels, depth = labels or 1, depth or 0
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts, steps = F.split("host", r"\."), F.split("path", "/", -1)
    # no rule has more labels or slashes than these, so longer expressions cannot meet one
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, F.greatest(k, F.lit(1))), "/"), F.lit("/"))))
    every = urls.select("*", F.posexplode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))).alias("at", "expression"))
    every = every.withColumn("digest", _digest(F.col("expression"))).withColumn("prefix", F.substring("digest", 1, 8)).drop("expression")
    on = ["prefix"]
    if n <= most_broadcast:
        table = F.broadcast(table)
    else:
        on = ["prefix", "salt"]
        every = every.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        table = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    e, r = every.alias("e"), table.alias("r")
    met = e.join(r, [F.col(f"e.{c}") == F.col(f"r.{c}") for c in on], "left")
    fits = (F.col("e.digest") == F.col("r.digest")) & F.col("e.path").startswith(F.col("r.path"))
    found = F.struct(F.length("r.rule").alias("length"), F.col("r.verdict").alias("verdict"), F.col("r.rule").alias("rule"))
    best = met.groupBy("e.id", "e.url", "e.host", "e.path").agg(F.max(F.when(fits, found)).alias("best"))
    copies = urls.groupBy("id", "url").agg(F.count("*").alias("n")).where("n > 1")
    c = copies.select(F.col("id").alias("c_id"), F.col("url").alias("c_url"), "n")
    rows = best.join(c, F.col("id").eqNullSafe(F.col("c_id")) & F.col("url").eqNullSafe(F.col("c_url")), "left")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1).cast("long")))))
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
