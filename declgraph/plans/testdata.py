"""Queries over the driver's tables: each kernel applied to a stand-in of the index tables, with its SQL oracle.

Orders stand for files, line items for declarations, labels for doc comments, events for logs, documents and pages for texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import diff, graph, history, intervals, ranks, resolve, scope, sessions
from ..schema import ACCESS, normal_access, rank

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mass(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("q"))
    orders = _t(spark, d, "orders").select("o_orderkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(F.col("o_orderkey").alias("path"), F.coalesce("n", F.lit(0)).cast("long").alias("declarations"), F.coalesce("q", F.lit(0.0)).cast("long").alias("bytes"))


_MASS = "SELECT o_orderkey AS path, coalesce(n, 0)::BIGINT AS declarations, coalesce(q, 0)::BIGINT AS bytes FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


@_query(_MASS)
def AG03_mass_per_file(spark, d):
    return _mass(spark, d)


@_query(f"""WITH m AS ({_MASS}), r AS (SELECT bytes, row_number() OVER (ORDER BY bytes DESC) AS k, count(*) OVER () AS n FROM m)
SELECT (SELECT quantile_disc(bytes, 0.5) FROM m)::BIGINT AS p50, (SELECT quantile_disc(bytes, 0.9) FROM m)::BIGINT AS p90, (SELECT max(bytes) FROM m)::BIGINT AS max_bytes,
(SELECT count(*) FROM m WHERE declarations = 0)::BIGINT AS empty_files, round((SELECT sum(bytes) FROM r WHERE k <= greatest(1, ceil(n * 0.1))) / (SELECT sum(bytes) FROM m), 6)::DOUBLE AS top_decile_share""")
def AG06_mass(spark, d):
    m = _mass(spark, d)
    one = m.agg(ranks.percentile("bytes", 0.5).cast("long").alias("p50"), ranks.percentile("bytes", 0.9).cast("long").alias("p90"), F.max("bytes").alias("max_bytes"), F.count_if(F.col("declarations") == 0).alias("empty_files"))
    share = ranks.concentration(m, "bytes", 0.1, "top_decile_share").select(F.round("top_decile_share", 6).alias("top_decile_share"))
    return one.crossJoin(F.broadcast(share))  # one row each


@_query(f"SELECT path, declarations, bytes FROM ({_MASS}) ORDER BY bytes DESC, path LIMIT 10")
def TK01_densest(spark, d):
    return ranks.top(_mass(spark, d), 10, F.desc("bytes"), "path")


@_query(f"SELECT count(*)::BIGINT AS files, sum(declarations)::BIGINT AS declarations, sum(bytes)::BIGINT AS source_bytes, count(*) FILTER (path % 10 = 0)::BIGINT AS test_files FROM ({_MASS})")
def AG02_overview(spark, d):
    return _mass(spark, d).agg(F.count("*").alias("files"), F.sum("declarations").alias("declarations"), F.sum("bytes").alias("source_bytes"), F.count_if(F.col("path") % 10 == 0).alias("test_files"))


@_query("SELECT count(*)::BIGINT AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' OR starts_with(o_orderpriority, '1-URGENT/')")
def AG01_scoped_count(spark, d):
    lines, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders").where(scope.in_path(F.col("o_orderpriority"), "1-URGENT"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).agg(F.count("*").alias("n"))


@_query("SELECT l_returnflag AS kind, count(*)::BIGINT AS n, sum(l_linenumber + 1)::BIGINT AS lines FROM lineitem GROUP BY 1")
def AG07_kinds(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber") + 1).alias("lines")).orderBy(F.desc("n"), "kind")


@_query("SELECT sum(strlen(text))::BIGINT AS source_bytes, sum(CASE WHEN lang = 'en' THEN strlen(text) ELSE 0 END)::BIGINT AS body_bytes, sum(length(text))::BIGINT AS doc_chars, round(sum(CASE WHEN lang = 'en' THEN strlen(text) ELSE 0 END) / sum(strlen(text)), 6)::DOUBLE AS ratio FROM documents")
def AG08_fold(spark, d):
    size, body = F.octet_length("text"), F.when(F.col("lang") == "en", F.octet_length("text")).otherwise(0)
    ratio = F.round(F.when(F.sum(size) > 0, F.sum(body) / F.sum(size)).otherwise(0.0), 6)
    return _t(spark, d, "documents").agg(F.sum(size).alias("source_bytes"), F.sum(body).alias("body_bytes"), F.sum(F.char_length("text")).alias("doc_chars"), ratio.alias("ratio"))


@_query("SELECT coalesce(nullif(CASE WHEN lang = 'es' THEN '' ELSE lang END, ''), 'internal') AS access, count(*)::BIGINT AS n, count(l.doc_id)::BIGINT AS documented, round(count(l.doc_id) / count(*), 6)::DOUBLE AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1")
def AG09_coverage(spark, d):
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("l_id")).distinct()
    docs = _t(spark, d, "documents").select("doc_id", normal_access(F.when(F.col("lang") == "es", "").otherwise(F.col("lang"))).alias("access"))
    got = docs.join(labels, docs.doc_id == labels.l_id, "left").groupBy("access").agg(F.count("*").alias("n"), F.count("l_id").alias("documented"))
    return got.withColumn("ratio", F.round(F.col("documented") / F.col("n"), 6)).orderBy(F.coalesce(rank(F.col("access"), ACCESS), F.lit(99)), "access")


@_query("SELECT json_extract_string(props, '$.k') AS tag, count(*)::BIGINT AS n FROM events GROUP BY 1")
def AG10_tags(spark, d):
    return _t(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("tag")).agg(F.count("*").alias("n"))


@_query("SELECT count(*)::BIGINT AS missing FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def AG11_missing(spark, d):
    returned = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, d, "orders").join(returned, "o_orderkey", "left_anti").agg(F.count("*").alias("missing"))


@_query("SELECT l_suppkey AS module, count(DISTINCT l_orderkey)::BIGINT AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, module LIMIT 10")
def AG12_coupling(spark, d):
    return ranks.top(_t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("module")).agg(F.count_distinct("l_orderkey").alias("n")), 10, F.desc("n"), "module")


@_query("SELECT r_name AS protocol_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def AG13_conformances(spark, d):
    c, n, r = (_t(spark, d, x) for x in ("customer", "nation", "region"))
    got = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    return ranks.top(got.groupBy(F.col("r_name").alias("protocol_name")).agg(F.count("*").alias("n")), 10, F.desc("n"), "protocol_name")


@_query("""SELECT s_suppkey AS target, count(DISTINCT c_custkey)::BIGINT AS callers FROM supplier JOIN customer ON s_suppkey % 97 = c_custkey % 97
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = s_suppkey AND p_size < 10) AND (s_nationkey = c_nationkey OR c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) GROUP BY 1""")
def AG14_fan_in(spark, d):
    documented = _t(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("s_suppkey"))
    targets = _t(spark, d, "supplier").join(documented, "s_suppkey", "left_anti").withColumn("name", F.col("s_suppkey") % 97)
    bound = _t(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("b")).distinct()
    callers = _t(spark, d, "customer").withColumn("name", F.col("c_custkey") % 97).join(bound, F.col("c_custkey") == F.col("b"), "left")
    # every target of a name has its callers with documents or bindings, and of the others those of its nation
    callers = callers.groupBy("name", "c_custkey", "c_nationkey").agg(F.max(F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False)) | F.col("b").isNotNull()).alias("any_"))
    every = callers.where("any_").select("name", "c_custkey").distinct()
    some = callers.join(every, ["name", "c_custkey"], "left_anti").groupBy("name", F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("some_"))
    counted = targets.select("s_suppkey", "name", "s_nationkey").distinct().join(every.groupBy("name").agg(F.count("*").alias("every_")), "name", "left").join(some, ["name", "s_nationkey"], "left")
    n = F.coalesce(F.max("every_"), F.lit(0)) + F.coalesce(F.sum("some_"), F.lit(0))
    return counted.groupBy(F.col("s_suppkey").alias("target")).agg(n.alias("callers")).where("callers > 0")


@_query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS guards FROM lineitem GROUP BY 1")
def AG15_guards(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("guards"))


@_query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS n FROM customer")
def AG16_counts_per_row(spark, d):
    n = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return _t(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


_OLD = "SELECT 'f' || (o_orderkey % 50) AS path, 'd' || (o_orderkey % 5000) AS decl_id, o_orderstatus AS signature, CASE o_orderkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN '' END AS access, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 4 < 3"
_NEW = "SELECT 'f' || (o_orderkey % 50) AS path, 'd' || (o_orderkey % 5000) AS decl_id, CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE o_orderstatus END AS signature, CASE o_orderkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN '' END AS access, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 4 > 0"
_CHANGES = f"""WITH o AS (SELECT path, decl_id, arg_min(signature, ordinal) AS s, arg_min(coalesce(access, '~'), ordinal) AS a FROM ({_OLD}) GROUP BY 1, 2),
n AS (SELECT path, decl_id, arg_max(signature, ordinal) AS s, arg_max(coalesce(access, '~'), ordinal) AS a FROM ({_NEW}) GROUP BY 1, 2)
SELECT path, decl_id, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s <> n.s THEN 'signature' END AS change,
coalesce(nullif(nullif(coalesce(nullif(n.a, '~'), nullif(o.a, '~')), '~'), ''), 'internal') AS access, 0::BIGINT AS lines FROM o FULL JOIN n USING (path, decl_id) WHERE o.s IS NULL OR n.s IS NULL OR o.s <> n.s"""


def _snapshots(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    access = F.when(k % 3 == 0, "public").when(k % 3 == 1, "")
    cols = [F.concat(F.lit("f"), k % 50).alias("path"), F.concat(F.lit("d"), k % 5000).alias("decl_id"), access.alias("access"), k.alias("ordinal")]
    old = o.where(k % 4 < 3).select(*cols, F.col("o_orderstatus").alias("signature"))
    new = o.where(k % 4 > 0).select(*cols, F.when(k % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("signature"))
    return old, new


@_query(_CHANGES)
def JN17_snapshot_diff(spark, d):
    return diff.changes(*_snapshots(spark, d)).withColumn("lines", F.col("lines").cast("long"))


@_query(f"SELECT count(DISTINCT path)::BIGINT AS files_changed, count(*) FILTER (change = 'added')::BIGINT AS added, count(*) FILTER (change = 'removed')::BIGINT AS removed, count(*) FILTER (change = 'signature')::BIGINT AS signature, count(*) FILTER (change = 'body')::BIGINT AS body, count(*) FILTER (change = 'added' AND access IN ('public', 'open'))::BIGINT AS api_added, count(*) FILTER (change = 'removed' AND access IN ('public', 'open'))::BIGINT AS api_removed FROM ({_CHANGES})")
def AG17_delta(spark, d):
    return diff.delta_totals(diff.changes(*_snapshots(spark, d)))


@_query("SELECT event_type AS path, count(DISTINCT event_id)::BIGINT AS commits, count(DISTINCT user_id)::BIGINT AS authors, sum(floor(value))::BIGINT AS insertions, sum(user_id)::BIGINT AS deletions, epoch_us(max(ts))::BIGINT AS last_change FROM events GROUP BY 1")
def AG18_churn(spark, d):
    log = _events(spark, d).select(F.col("event_type").alias("path"), F.col("user_id").alias("author"), F.col("event_id").alias("commit"), F.col("us").alias("at"), F.floor("value").cast("long").alias("insertions"), F.col("user_id").alias("deletions"))
    return history.churn(log)


def _events(spark, d):
    e = _t(spark, d, "events")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@_query("""WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events), r AS (SELECT min(us) AS lo, max(us) AS hi FROM e),
b AS (SELECT event_type, greatest(0, least(11, floor((us - lo) / ((hi - lo) / 12.0))))::INTEGER AS b FROM e, r)
SELECT t.event_type, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY k.k) AS series FROM (SELECT DISTINCT event_type FROM b) t CROSS JOIN (SELECT unnest(range(12)) AS k) k LEFT JOIN (SELECT event_type, b, count(*) AS n FROM b GROUP BY 1, 2) c ON c.event_type = t.event_type AND c.b = k.k GROUP BY 1""")
def AG19_sparkline(spark, d):
    e = _events(spark, d)
    lo, hi = e.agg(F.min("us"), F.max("us")).first()
    b = e.withColumn("b", history.bucket(F.col("us"), F.lit(lo), F.lit((hi - lo) / 12.0), 12))
    return history.sparkline(b, "event_type", "b", 12).select("event_type", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


@_query("SELECT user_id AS path, epoch_us(max(ts))::BIGINT AS touched FROM events GROUP BY 1")
def AG20_last_touched(spark, d):
    return history.last_touched(_events(spark, d).select(F.col("user_id").alias("path"), F.col("us").alias("at")))


@_query("SELECT event_type AS command, count(*)::BIGINT AS calls, count(*) FILTER (user_id % 9 = 0)::BIGINT AS failed, quantile_disc(event_id, 0.5)::BIGINT AS p50, quantile_disc(event_id, 0.9)::BIGINT AS p90 FROM events GROUP BY 1")
def AG22_command_stats(spark, d):
    return sessions.command_stats(_t(spark, d, "events"), "event_type", F.col("user_id") % 9 == 0, "event_id")


@_query("SELECT event_type, user_id, count(*)::BIGINT AS n FROM events WHERE user_id % 9 = 0 GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 10")
def AG23_usage_errors(spark, d):
    return ranks.top(_t(spark, d, "events").where("user_id % 9 = 0").groupBy("event_type", "user_id").agg(F.count("*").alias("n")), 10, F.desc("n"), "event_type", "user_id")


@_query("""WITH w AS (SELECT event_type AS after, epoch_us(ts) AS us, lag(event_type) OVER p AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER p AS since FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT before, after, count(*)::BIGINT AS n FROM w WHERE before <> after AND since BETWEEN 0 AND 36000000000 GROUP BY 1, 2""")
def AG24_rereads(spark, d):
    return sessions.rereads(_events(spark, d), "user_id", F.col("event_type"), F.col("us"), ["ts", "event_id"], 36_000_000_000)


@_query("SELECT count(*) FILTER (state = 'unindexed')::BIGINT AS added, count(*) FILTER (state = 'modified')::BIGINT AS updated, count(*) FILTER (state = 'fresh')::BIGINT AS skipped, count(*) FILTER (state = 'missing')::BIGINT AS removed FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'unindexed' WHEN doc_id % 10 = 2 THEN 'modified' ELSE 'fresh' END AS state FROM documents)")
def AG27_index_counters(spark, d):
    return diff.index_counters(_states(spark, d))


def _states(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    disk = docs.where("path % 10 <> 0")
    index = docs.where("path % 10 <> 1").withColumn("sha256", F.when(F.col("path") % 10 == 2, F.lit("")).otherwise(F.col("sha256")))
    return diff.file_states(disk, index)


@_query("SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'unindexed' WHEN doc_id % 10 = 2 THEN 'modified' ELSE 'fresh' END AS state FROM documents")
def MT03_check(spark, d):
    return _states(spark, d)


@_query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), lambda x: x <> ''))::INTEGER AS lines FROM documents")
def AG29_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.lines_with_text(F.coalesce("text", F.lit(""))).alias("lines"))


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
_RANGES = f"SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS id, l_orderkey AS k, l_linenumber::BIGINT AS s, l_quantity::BIGINT AS n FROM lineitem"


def _ranges(spark, d):
    """Every line of an order as a range of the order; the id is the order's with the line's rank in it."""
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return _t(spark, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("id"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("s"), F.col("l_quantity").cast("long").alias("n"))


@_query(f"""WITH r AS ({_RANGES}), p AS (SELECT id AS pid, k, s + 2 AS at_ FROM r)
SELECT p.pid, coalesce((SELECT r.id FROM r WHERE r.k = p.k AND p.at_ >= r.s AND p.at_ < r.s + r.n ORDER BY r.n, r.id LIMIT 1), -1)::BIGINT AS owner FROM p""")
def JN13_owner(spark, d):
    r = _ranges(spark, d)
    points = r.select(F.col("id").alias("pid"), "k", (F.col("s") + 2).alias("at_"))
    return intervals.innermost_owner(points, r, "k", "at_", "s", "n", "id", "pid").select("pid", F.coalesce("owner", F.lit(-1)).alias("owner"))


@_query(f"WITH r AS ({_RANGES}) SELECT a.id AS outer_id, b.id AS inner_id FROM r a JOIN r b ON a.k = b.k AND b.s >= a.s AND b.s + b.n <= a.s + a.n AND b.n < a.n")
def JN15_descendants(spark, d):
    r = _ranges(spark, d)
    return intervals.contained(r, r, "k", "s", "n", "id")


@_query(f"WITH r AS ({_RANGES}), c AS (SELECT b.id AS inner_id, a.id AS outer_id, row_number() OVER (PARTITION BY b.id ORDER BY a.n, a.id) AS at_ FROM r a JOIN r b ON a.k = b.k AND b.s >= a.s AND b.s + b.n <= a.s + a.n AND b.n < a.n) SELECT inner_id, outer_id FROM c WHERE at_ = 1")
def JN14_enclosing(spark, d):
    r = _ranges(spark, d)
    return intervals.smallest_enclosing(r, r, "k", "s", "n", "id")


@_query(f"WITH r AS ({_RANGES}) SELECT id, k, s, n FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.k = r.k AND r.s >= o.s AND r.s + r.n <= o.s + o.n AND r.n < o.n)")
def FL15_drop_nested(spark, d):
    return intervals.drop_nested(_ranges(spark, d), "k", "s", "n", "id").select("id", "k", "s", "n")


@_query(f"WITH r AS ({_RANGES}) SELECT a.id, sum(least(a.s + a.n, b.s + 5) - greatest(a.s, b.s) + 1)::BIGINT AS lines FROM r a JOIN r b ON a.k = b.k AND a.s <= b.s + 5 AND b.s <= a.s + a.n GROUP BY 1")
def JN16_overlap(spark, d):
    r = _ranges(spark, d).withColumn("hi", F.col("s") + F.col("n"))
    return intervals.overlap_sum(r.select("id", "k", "s", "hi"), r.select("k", F.col("s").alias("o"), (F.col("s") + 5).alias("oh")), "k", "id", "s", "hi", "o", "oh", "lines")


@_query("SELECT p_partkey AS id, CASE WHEN any_name THEN 1 ELSE 2 END AS rung FROM (SELECT p_partkey, p_brand = 'Brand#11' AS by_name, lower(p_type || p_name) LIKE '%brand#11%' AS by_part, bool_or(p_brand = 'Brand#11') OVER () AS any_name FROM part) WHERE CASE WHEN any_name THEN by_name ELSE by_part END")
def RS01_resolve_ladder(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_type", "p_name").alias("decl_id"), F.col("p_brand").alias("name"), F.col("p_name").alias("signature"))
    return resolve.for_calls(parts, "Brand#11").select("id", "rung")


@_query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND p_size BETWEEN 5 AND 20")
def FL04_name_like(spark, d):
    return _t(spark, d, "part").where(scope.name_like(F.col("p_name"), "Red") & F.col("p_size").between(5, 20)).select("p_partkey")


@_query("SELECT p_partkey FROM part WHERE contains(',' || replace(p_name, ' ', ',') || ',', ',bolt,')")
def FL08_spi(spark, d):
    return _t(spark, d, "part").where(scope.spi_is(F.split("p_name", " "), "bolt")).select("p_partkey")


@_query("SELECT doc_id FROM documents WHERE coalesce(nullif(CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN '' END, ''), 'internal') IN ('open', 'public', 'package', 'internal')")
def FL07_access_floor(spark, d):
    access = F.when(F.col("doc_id") % 4 == 0, "public").when(F.col("doc_id") % 4 == 1, "private").when(F.col("doc_id") % 4 == 2, "")
    return _t(spark, d, "documents").where(scope.access_floor(access, "internal")).select("doc_id")


@_query("SELECT page_id FROM pages WHERE regexp_matches(url, '(?s)^https://[^/]*[.]example[.]com/en/.*$')")
def SC02_glob(spark, d):
    return _t(spark, d, "pages").where(scope.matches_glob(F.col("url"), "https://*.example.com/en/**")).select("page_id")


@_query("SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '(^|/)en(/|$)') AND NOT regexp_matches(url, '/nothing$')) ")
def SC03_gitignore(spark, d):
    path = F.regexp_replace("url", "^https?://", "")
    return _t(spark, d, "pages").where(~scope.ignored(path, ["# rules", "en/", "!nothing"])).select("page_id")


@_query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def SC05_content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@_query("SELECT item_id, substr(regexp_replace(text, '[^ -~]', '', 'g'), 6, 20) AS part FROM benchmark")
def SC10_slice(spark, d):
    content = F.regexp_replace("text", "[^ -~]", "").cast("binary")
    return _t(spark, d, "benchmark").select("item_id", tx.byte_slice(content, F.lit(5), F.lit(20)).alias("part"))


@_query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: CASE WHEN regexp_matches(x, '^[A-Z]') THEN x ELSE '' END), lambda x: x <> ''))), ',') AS names FROM documents")
def SF01_dependencies(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(tx.type_names(F.col("text"))), ",").alias("names"))


@_query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents")
def SF07_one_space(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.one_space(F.col("text")).alias("t"))


@_query("SELECT doc_id, CASE WHEN n_chars < 1000 THEN n_chars || ' B' ELSE printf('%.1f KB', floor(n_chars / 100.0 + 0.5) / 10.0) END AS size FROM documents")
def SF13_size_label(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.size_label(F.col("n_chars")).alias("size"))


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def TK02_page(spark, d):
    return ranks.page(_t(spark, d, "orders"), 100, 50, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@_query("SELECT coalesce(max(CASE WHEN n_chars <= 1500 THEN doc_id END), 0)::BIGINT AS level FROM documents")
def TK07_budget(spark, d):
    return ranks.deepest_within(_t(spark, d, "documents").select(F.col("doc_id").alias("level"), F.col("n_chars").alias("bytes")), 1500)


@_query("SELECT DISTINCT source, lang FROM documents")
def FL22_distinct(spark, d):
    return _t(spark, d, "documents").select("source", "lang").distinct()


@_query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def FL06_tag_semi_join(spark, d):
    tags = _t(spark, d, "labels").select(F.col("doc_id").alias("decl"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("tag"), F.lit("").alias("value"))
    return scope.with_tag(_t(spark, d, "documents").select("doc_id"), tags, "good", "doc_id", "decl")


# The call graph: customers are declarations, orders call sites and bindings.
_DECLS = """SELECT c_custkey AS id, 'd' || c_custkey AS decl_id, c_nationkey::BIGINT AS file_id, c_mktsegment AS container,
CASE c_custkey % 7 WHEN 0 THEN 'protocol' WHEN 1 THEN 'extension' WHEN 2 THEN 'var' ELSE 'func' END AS kind, 'n' || (c_custkey % 400) AS name, 'n' || (c_custkey % 400) || ': ' || CASE c_custkey % 3 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS signature FROM customer"""
_SITES = """SELECT o_orderkey AS id, o_custkey % 25 AS file_id, CASE WHEN o_orderkey % 11 > 0 THEN o_custkey END AS from_decl, 'n' || (o_orderkey % 500) AS name,
CASE o_orderkey % 5 WHEN 1 THEN 'self' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'n' || (o_orderkey % 13) WHEN 4 THEN 'a.b' END AS receiver, CASE WHEN o_orderkey % 6 = 0 THEN 'ref' ELSE 'call' END AS kind, o_orderkey % 1000 AS line FROM orders"""
_BINDINGS = "SELECT o_custkey AS from_decl, 'n' || (o_orderkey % 13) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'FURNITURE' WHEN 1 THEN 'AUTOMOBILE' ELSE 'n7' END AS type, o_orderkey AS line FROM orders WHERE o_orderkey % 3 = o_custkey % 3"
_CONFORM = "(VALUES ('BUILDING', 'n7'), ('MACHINERY', 'BUILDING'), ('FURNITURE', 'AUTOMOBILE'), ('HOUSEHOLD', 'FURNITURE'))"
_ROWS = f"""d AS ({_DECLS}), s0 AS (SELECT * FROM ({_SITES}) WHERE kind = 'call'), b AS ({_BINDINGS}), c(t, p) AS {_CONFORM},
conf AS (SELECT t, p FROM c UNION SELECT x.t, y.p FROM c x JOIN c y ON x.p = y.t),
s1 AS (SELECT s0.id AS site, s0.file_id AS origin_file, from_decl AS origin, s0.name, CASE WHEN receiver NOT IN ('self', 'Self') THEN receiver END AS receiver, s0.kind AS site_kind, line, o.container AS origin_container FROM s0 LEFT JOIN d o ON o.id = s0.from_decl),
s AS (SELECT s1.*, CASE WHEN regexp_matches(receiver, '^[A-Za-z0-9_]+$') THEN coalesce(
 (SELECT arg_min(b.type, b.line) FROM b WHERE b.from_decl = s1.origin AND b.name = s1.receiver),
 (SELECT arg_min(regexp_extract(v.signature, ':\\s*([A-Za-z_][A-Za-z0-9_]*)', 1), v.id) FROM d v WHERE v.kind IN ('var', 'let') AND v.name = s1.receiver AND v.container = s1.origin_container),
 (SELECT arg_min(regexp_extract(v.signature, ':\\s*([A-Za-z_][A-Za-z0-9_]*)', 1), v.id) FROM d v WHERE v.kind IN ('var', 'let') AND v.name = s1.receiver)) END AS rt FROM s1),
n AS (SELECT name, count(*) AS n_all, count(*) FILTER (kind <> 'extension') AS n_calls FROM d GROUP BY 1),
r0 AS (SELECT s.*, d.id AS target, d.container, d.file_id, d.kind AS target_kind, n_all, n_calls, EXISTS (SELECT 1 FROM conf WHERE conf.t = d.container AND conf.p = s.rt) AS conforms, EXISTS (SELECT 1 FROM d q WHERE q.kind = 'protocol' AND q.name = s.rt) AS known FROM s JOIN d USING (name) JOIN n USING (name)),
r AS (SELECT *, {{grade_all}} AS rank_in, {{grade_calls}} AS rank_out FROM r0)"""


def _grade_sql(unique: str) -> str:
    return f"""CASE WHEN receiver IS NULL THEN CASE WHEN {unique} THEN 2 WHEN origin_container = container THEN 1 WHEN origin_file = file_id THEN 1 ELSE 0 END
 WHEN receiver = container THEN 2 WHEN rt IS NOT NULL AND rt = container THEN 2 WHEN rt IS NOT NULL AND conforms THEN 1 WHEN rt IS NOT NULL AND NOT known THEN 0 WHEN {unique} THEN 1 ELSE 0 END"""


_ROWS = _ROWS.format(grade_all=_grade_sql("n_all = 1"), grade_calls=_grade_sql("n_calls = 1"))


def _graph_tables(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    k, n = F.col("c_custkey"), F.col("o_orderkey")
    kind = F.when(k % 7 == 0, "protocol").when(k % 7 == 1, "extension").when(k % 7 == 2, "var").otherwise("func")
    name = F.concat(F.lit("n"), k % 400)
    decls = c.select(k.alias("id"), F.concat(F.lit("d"), k).alias("decl_id"), F.col("c_nationkey").cast("long").alias("file_id"), F.col("c_mktsegment").alias("container"), kind.alias("kind"), name.alias("name"), F.concat(name, F.lit(": "), F.when(k % 3 == 0, "BUILDING").otherwise("MACHINERY")).alias("signature"))
    receiver = F.when(n % 5 == 1, "self").when(n % 5 == 2, "BUILDING").when(n % 5 == 3, F.concat(F.lit("n"), n % 13)).when(n % 5 == 4, "a.b")
    sites = o.select(n.alias("id"), (F.col("o_custkey") % 25).alias("file_id"), F.when(n % 11 > 0, F.col("o_custkey")).alias("from_decl"), F.concat(F.lit("n"), n % 500).alias("name"), receiver.alias("receiver"), F.when(n % 6 == 0, "ref").otherwise("call").alias("kind"), (n % 1000).alias("line"))
    bindings = o.where(n % 3 == F.col("o_custkey") % 3).select(F.col("o_custkey").alias("from_decl"), F.concat(F.lit("n"), n % 13).alias("name"), F.when(n % 3 == 0, "FURNITURE").when(n % 3 == 1, "AUTOMOBILE").otherwise("n7").alias("type"), n.alias("line"))
    conform = spark.createDataFrame([("BUILDING", "n7"), ("MACHINERY", "BUILDING"), ("FURNITURE", "AUTOMOBILE"), ("HOUSEHOLD", "FURNITURE")], "type_name string, protocol_name string")
    return sites, decls, bindings, conform


def _graph_rows(spark, d):
    sites, decls, bindings, conform = _graph_tables(spark, d)
    return decls, graph.candidates(sites, decls, bindings, conform), conform


@_query(f"WITH {_ROWS} SELECT site, target, rank_in, rank_out FROM r")
def GR02_grade(spark, d):
    return _graph_rows(spark, d)[1].select("site", "target", "rank_in", "rank_out")


_IN = f"WITH {_ROWS}, e AS (SELECT target, origin, count(*)::BIGINT AS occurrences, max(rank_in) AS rank, arg_min({{'line': line, 'receiver': receiver}}, {{'a': -rank_in, 'b': origin_file, 'c': line, 'd': site}}) AS x FROM r WHERE origin IS NULL OR origin <> target GROUP BY 1, 2)"


@_query(_IN + " SELECT target, coalesce(origin, 0) AS origin, occurrences, rank, x.line AS line, x.receiver AS receiver FROM e")
def GR05_callers(spark, d):
    return graph.callers(*_graph_tables(spark, d)).drop("via").withColumn("origin", F.coalesce("origin", F.lit(0)))


_OUT = f"""WITH {_ROWS}, u AS (SELECT *, coalesce(container = receiver, false) AS named FROM r WHERE origin IS NOT NULL AND (site_kind <> 'call' OR target_kind <> 'extension')),
w AS (SELECT * FROM (SELECT *, bool_or(named) OVER (PARTITION BY site) AS any_named FROM u) WHERE named OR NOT any_named),
h AS (SELECT *, max(rank_out) OVER (PARTITION BY site) AS best FROM w WHERE origin <> target),
e AS (SELECT origin, target, count(*)::BIGINT AS occurrences, max(rank_out) AS rank, arg_min({{'line': line, 'receiver': receiver}}, {{'c': line, 'd': site}}) AS x FROM h WHERE best < 2 OR rank_out = 2 GROUP BY 1, 2)"""


@_query(_OUT + " SELECT origin, target, occurrences, rank, x.line AS line, x.receiver AS receiver FROM e")
def GR07_callees(spark, d):
    return graph.callees(*_graph_tables(spark, d)).drop("via")


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS a, ((n_nationkey * 7 + k) % 25)::BIGINT AS b FROM nation, (SELECT unnest([1, 5, 9]) AS k)),
w AS (SELECT n_nationkey::BIGINT AS root, 0 AS depth, n_nationkey::BIGINT AS node, [n_nationkey::BIGINT] AS path, false AS cycle FROM nation WHERE n_nationkey > 0
UNION ALL SELECT root, depth + 1, b, list_append(path, b), list_contains(path, b) AND b <> 0 FROM w JOIN e ON node = a WHERE depth < 2 AND NOT cycle)
SELECT root, depth, node, array_to_string(path, '>') AS path, cycle FROM w""")
def GR09_traverse(spark, d):
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    edges = nation.select("a", F.explode(F.array(F.lit(1), F.lit(5), F.lit(9))).alias("k")).select(F.col("a").alias("src"), ((F.col("a") * 7 + F.col("k")) % 25).alias("dst"), F.lit(2).alias("rank"), F.lit(1).alias("line")).distinct()
    tree = graph.traverse(nation.where("a > 0").select(F.col("a").alias("node")), edges, depth=2)
    return tree.select("root", "depth", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "cycle")


@_query("SELECT x.t AS type_name, y.p AS parent FROM (SELECT 'c' || c_custkey AS t, 'n' || c_nationkey AS p FROM customer) x JOIN (SELECT 'n' || n_nationkey AS t, 'r' || n_regionkey AS p FROM nation) y ON x.p = y.t UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def GR03_conforms(spark, d):
    c = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("type_name"), F.concat(F.lit("n"), "c_nationkey").alias("protocol_name"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("type_name"), F.concat(F.lit("r"), "n_regionkey").alias("protocol_name"))
    return graph.conforming(c.unionByName(n))


@_query("SELECT doc_id AS path FROM documents EXCEPT SELECT doc_id FROM labels")
def SO01_removed(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("path")).subtract(_t(spark, d, "labels").select("doc_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass of files and repeated reads in one report: metric and value."""
    mass = AG06_mass(spark, sf_dir)
    stacked = mass.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in mass.columns)), F.array(*(F.col(c).cast("double") for c in mass.columns)))).alias("metric", "value"))
    pairs = AG24_rereads(spark, sf_dir).select(F.concat(F.lit("reread "), "before", F.lit(" > "), "after").alias("metric"), F.col("n").cast("double").alias("value"))
    return stacked.unionByName(pairs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import testdata_entries, testdata_history, testdata_more, testdata_search, testdata_source  # noqa: F401  they register their queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import testdata_entries, testdata_history, testdata_more, testdata_search, testdata_source  # noqa: F401

    return dict(_SQL)
