"""Version-control logs over the driver's tables: every five events are written out as a commit's record, so that SQL over events
tells what the log says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history
from ..sources import git
from .testdata import _query, _t

_COMMITS = "SELECT event_id // 5 AS k, md5((event_id // 5)::VARCHAR) AS \"commit\", 'U ' || arg_min(user_id, event_id) AS author, arg_min(epoch_us(ts), event_id) // 1000000 AS \"at\" FROM events GROUP BY 1, 2"
_PATH = "'src/' || CASE WHEN event_id % 7 = 0 THEN 'new/' ELSE '' END || event_type || event_id % 40 || '.swift'"
_FILES = f"SELECT event_id, event_id // 5 AS k, {_PATH} AS path, CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 97 END::BIGINT AS insertions, CASE WHEN event_id % 11 = 0 THEN 0 ELSE user_id END::BIGINT AS deletions FROM events"
_LOG = f"SELECT \"commit\", author, \"at\", path, insertions, deletions FROM ({_FILES}) JOIN ({_COMMITS}) USING (k)"


def _records(spark, d, numstat: bool = True) -> DataFrame:
    """value: one record of the log for five events; every seventh file was moved, every eleventh is binary."""
    e = _t(spark, d, "events")
    k, own = F.col("event_id"), F.concat("event_type", (F.col("event_id") % 40).cast("string"), F.lit(".swift"))
    moved = k % 7 == 0
    numbers = F.when(k % 11 == 0, F.lit("-\t-")).otherwise(F.concat_ws("\t", k % 97, "user_id"))
    stat = F.concat(numbers, F.lit("\t"), F.when(moved, F.concat(F.lit("src/{old => new}/"), own)).otherwise(F.concat(F.lit("src/"), own)))
    name = F.concat(F.when(moved, F.lit("src/new/")).otherwise(F.lit("src/")), own)
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    of = F.floor(k / 5)
    found = e.groupBy(of.alias("k")).agg(F.min_by("user_id", k).alias("u"), F.min_by(seconds, k).alias("at"), F.array_sort(F.collect_list(F.struct(k, (stat if numstat else name).alias("line")))).alias("lines"))  # five rows
    head = F.concat(F.lit("commit\t"), F.md5(F.col("k").cast("string")), F.lit("\tU "), F.col("u").cast("string"), F.lit("\t"), F.col("at").cast("string"))
    return found.select(F.concat(head, F.lit("\n\n"), F.array_join("lines.line", "\n"), F.lit("\n")).alias("value"))


@_query(_LOG)
def SC11_log(spark, d):
    return git.parse_numstat(_records(spark, d))


@_query(f"SELECT path, count(DISTINCT \"commit\")::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions, max(\"at\")::BIGINT AS last_change FROM ({_LOG}) GROUP BY 1")
def AG18_log_churn(spark, d):
    return history.churn(git.parse_numstat(_records(spark, d)))


@_query(f"SELECT substr(path, 5) AS path, max(\"at\")::BIGINT AS touched FROM ({_LOG}) GROUP BY 1")
def AG20_log_last_touched(spark, d):
    return history.last_touched(git.parse_names(_records(spark, d, numstat=False), "src"))


@_query("SELECT 'Order' || l_orderkey || '.swift' AS path, l_partkey::INTEGER AS low, (l_partkey + greatest(CASE WHEN l_linenumber = 1 THEN 1 ELSE l_linenumber - 2 END, 1) - 1)::INTEGER AS high FROM lineitem")
def SC11_hunks(spark, d):
    """A diff with a file for each order and a hunk for each of its lines; a hunk of one line has no count, others may have 0."""
    line = F.col("l_linenumber")
    new = F.concat(F.lit("+"), F.col("l_partkey").cast("string"), F.when(line == 1, "").otherwise(F.concat(F.lit(","), (line - 2).cast("string"))))
    hunk = F.concat(F.lit("@@ -1,2 "), new, F.lit(" @@ func f()\n+++ b/Other.swift\n-gone"))
    path = F.concat(F.lit("Order"), F.col("l_orderkey").cast("string"), F.lit(".swift"))
    found = _t(spark, d, "lineitem").groupBy(path.alias("p")).agg(F.concat_ws("\n", F.collect_list(hunk)).alias("h"))  # an order's lines
    value = F.concat(F.lit("a/"), F.col("p"), F.lit(" b/"), F.col("p"), F.lit("\nindex 1..2 100644\n--- a/"), F.col("p"), F.lit("\n+++ b/"), F.col("p"), F.lit("\n"), F.col("h"))
    return git.parse_hunks(found.select(value.alias("value")))
