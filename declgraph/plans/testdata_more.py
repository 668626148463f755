"""More queries over the driver's tables: joins, ranked lists, windows, dispatch, reports, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, history, ranks, resolve, scope
from .testdata import _IN, _MASS, _OUT, _ROWS, _events, _graph_rows, _graph_tables, _mass, _query, _t


@_query(f"SELECT quantile_disc(declarations, 0.25)::BIGINT AS p25, quantile_disc(declarations, 0.75)::BIGINT AS p75, quantile_disc(declarations, 1.0)::BIGINT AS p100 FROM ({_MASS})")
def AG04_percentiles(spark, d):
    return _mass(spark, d).agg(*(ranks.percentile("declarations", p).cast("long").alias(n) for p, n in ((0.25, "p25"), (0.75, "p75"), (1.0, "p100"))))


@_query("WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS k, count(*) OVER () AS n FROM orders) SELECT round(sum(v) FILTER (k <= greatest(1, ceil(n * 0.2))) / sum(v), 6)::DOUBLE AS share FROM r")
def AG05_concentration(spark, d):
    return ranks.concentration(_t(spark, d, "orders"), "o_totalprice", 0.2).select(F.round("share", 6).alias("share"))


_CHURN = "SELECT event_type AS path, count(DISTINCT event_id)::BIGINT AS commits FROM events GROUP BY 1"


@_query(f"SELECT (SELECT count(*) FROM ({_CHURN}))::BIGINT AS files_changed, (SELECT sum(commits) FROM ({_CHURN}))::BIGINT AS commits, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS authors")
def AG21_volatility_totals(spark, d):
    e = _t(spark, d, "events")
    files = e.groupBy("event_type").agg(F.count_distinct("event_id").alias("commits")).agg(F.count("*").alias("files_changed"), F.sum("commits").alias("commits"))
    return files.crossJoin(F.broadcast(e.agg(F.count_distinct("user_id").alias("authors"))))  # one row each


@_query("SELECT p_brand AS name, count(*)::BIGINT AS n FROM part GROUP BY 1")
def AG28_name_frequency(spark, d):
    return _t(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))


@_query("SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def JN01_inner(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'P'")
    return _t(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderpriority")


@_query("SELECT c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def JN02_left_keeps_empty(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def JN04_anti(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@_query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def JN06_semi(spark, d):
    return _t(spark, d, "supplier").join(_t(spark, d, "nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@_query("SELECT coalesce(a.k, b.k) AS path, coalesce(a.n, 0)::BIGINT AS mass, coalesce(b.n, 0)::BIGINT AS churn FROM (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*)::BIGINT AS n FROM events GROUP BY 1) b ON a.k = b.k")
def JN20_merge_lists(spark, d):
    a = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("mass"))
    return a.join(_t(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.count("*").alias("churn")), "path", "full_outer").select("path", F.coalesce("mass", F.lit(0)).cast("long").alias("mass"), F.coalesce("churn", F.lit(0)).cast("long").alias("churn"))


@_query("SELECT user_id, event_id, rank_ FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank_ FROM events) WHERE rank_ <= 3")
def WN02_limit_per_node(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return _t(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank_")).where("rank_ <= 3")


@_query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_ FROM orders GROUP BY 1")
def WN05_earliest(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_"))


@_query("SELECT o_orderkey, coalesce(o_orderdate <> lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS is_new FROM orders")
def WN09_header_on_change(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, d, "orders").select("o_orderkey", F.coalesce(F.col("o_orderdate") != F.lag("o_orderdate").over(w), F.lit(True)).alias("is_new"))


@_query("SELECT user_id, sum(floor(value))::BIGINT AS lines FROM events GROUP BY 1 ORDER BY lines DESC, user_id DESC LIMIT 20")
def TK03_both_descending(spark, d):
    return ranks.top(_t(spark, d, "events").groupBy("user_id").agg(F.sum(F.floor("value")).alias("lines")), 20, F.desc("lines"), F.desc("user_id"))


@_query("SELECT p_partkey FROM part ORDER BY p_size >= 40, p_name, p_partkey LIMIT 25")
def WN08_tests_last(spark, d):
    return ranks.tests_last(_t(spark, d, "part"), F.col("p_size") >= 40, "p_name", "p_partkey").limit(25).select("p_partkey")


@_query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '(?i)^.*1.$')")
def FL16_keep_pattern(spark, d):
    return _t(spark, d, "part").where(scope.kept_by_pattern(F.col("p_brand"), F.col("p_name"), "*1?")).select("p_partkey")


@_query("SELECT p_partkey AS id FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def FL11_resolve_exact(spark, d):
    parts = _t(spark, d, "part")
    first = parts.agg(F.min("p_name")).first()[0]
    return resolve.lookup(parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("decl_id"), F.col("p_brand").alias("name")), first).select("id")


@_query("SELECT page_id, CASE WHEN regexp_extract(u, '^[^/]+/([^/]+)/', 1) = '' OR NOT starts_with(u, 'x/') THEN '-' ELSE regexp_extract(u, '^x/([^/]+)/', 1) END AS module FROM (SELECT page_id, replace(url, 'https://', 'x/') AS u FROM pages)")
def SF03_module(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.module_of(F.replace("url", F.lit("https://"), F.lit("x/")), "x").alias("module"))


@_query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS label FROM pages")
def SF24_label(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.last_segment(F.col("url")).alias("label"))


@_query("SELECT doc_id, printf('%.1f%%', floor(n_chars % 1000 / 1000.0 * 1000 + 0.5) / 10.0) AS pct FROM documents")
def SF14_percent(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.percent_label((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("pct"))


@_query("SELECT event_id, trunc((1800000000 - epoch_us(ts) / 1000000.0) / 86400)::INTEGER AS age FROM events")
def SF23_days_since(spark, d):
    return _events(spark, d).select("event_id", history.days_since(F.col("us") / 1e6, F.lit(1_800_000_000.0)).alias("age"))


_FLAGS = "SELECT o_custkey AS path, count(*)::BIGINT AS churn, count(*) FILTER (o_orderstatus <> 'O')::BIGINT AS declarations, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS directives, (o_custkey * 7 % 800)::INTEGER AS age FROM orders GROUP BY 1"


@_query(f"""WITH f AS ({_FLAGS}), t AS (SELECT greatest(1, quantile_disc(churn, 0.75)) AS t FROM f WHERE churn > 0),
x AS (SELECT *, churn >= t AND churn > 0 AS hot, declarations > 0 AND coverage < 0.25 AS thin FROM f, t)
SELECT path, concat_ws(',', CASE WHEN hot THEN 'hot' END, CASE WHEN thin THEN 'thin-docs' END, CASE WHEN directives = 0 THEN 'unmapped' END, CASE WHEN age > 365 THEN 'dormant' END, CASE WHEN hot AND thin THEN 'review' END) AS flags FROM x""")
def SF22_flags(spark, d):
    o = _t(spark, d, "orders")
    status = F.col("o_orderstatus")
    f = o.groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("churn"), F.count_if(status != "O").alias("declarations"), F.round(F.avg(F.when(status == "F", 1.0).otherwise(0.0)), 6).alias("coverage"), F.count_if(status == "P").alias("directives")).withColumn("age", (F.col("path") * 7 % 800).cast("int"))
    x = f.crossJoin(F.broadcast(history.hot_threshold(f)))  # one row
    flags = history.flags(F.col("churn"), F.col("declarations"), F.col("coverage"), F.col("directives"), F.col("age"), F.col("threshold"))
    return x.select("path", F.array_join(flags, ",").alias("flags"))


_PAIRS = "i AS (SELECT DISTINCT r.id AS requirement, m.id AS implementation FROM c JOIN d r ON r.container = c.p JOIN d m ON m.container = c.t AND m.name = r.name WHERE c.t <> c.p)"


@_query(f"WITH {_ROWS}, {_PAIRS} SELECT requirement, implementation FROM i")
def JN11_implementations(spark, d):
    _, decls, _, conform = _graph_tables(spark, d)
    return graph.implementations(decls, conform)


@_query(_IN + f""", {_PAIRS}, u2 AS (SELECT target, origin, occurrences, rank, true AS own, NULL::BIGINT AS via FROM e
UNION ALL SELECT implementation, origin, occurrences, least(rank, 1), false, requirement FROM e JOIN i ON e.target = i.requirement WHERE origin IS NULL OR origin <> implementation)
SELECT target, coalesce(origin, -1) AS origin, max(rank) AS rank, coalesce(max(occurrences) FILTER (own), max(occurrences))::BIGINT AS occurrences FROM u2 GROUP BY 1, 2""")
def GR06_callers_with_dispatch(spark, d):
    return graph.callers_with_dispatch(*_graph_tables(spark, d)).select("target", F.coalesce("origin", F.lit(-1)).alias("origin"), "rank", "occurrences")


@_query(_OUT + f""", {_PAIRS}, more AS (SELECT DISTINCT e.origin, implementation AS target, least(e.rank, 1) AS rank FROM e JOIN d q ON q.id = e.target JOIN i ON i.requirement = e.target WHERE q.container IN (SELECT name FROM d WHERE kind = 'protocol') AND e.origin <> implementation)
SELECT origin, target, rank FROM e UNION ALL SELECT origin, target, max(rank) FROM more m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.origin = m.origin AND e.target = m.target) GROUP BY 1, 2""")
def GR08_callees_with_dispatch(spark, d):
    return graph.callees_with_dispatch(*_graph_tables(spark, d)).select("origin", "target", "rank")


@_query(_OUT + " SELECT origin, count(*) FILTER (rank < 1)::BIGINT AS suppressed, count(*)::BIGINT AS edges FROM e GROUP BY 1")
def GR11_suppressed(spark, d):
    return graph.callee_counts(*_graph_tables(spark, d)).select("origin", "suppressed", "edges")


_TREE = """WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS a, ((n_nationkey * 7 + k) % 25)::BIGINT AS b FROM nation, (SELECT unnest([1, 5, 9]) AS k)),
w AS (SELECT n_nationkey::BIGINT AS root, 0 AS depth, n_nationkey::BIGINT AS node, [n_nationkey::BIGINT] AS path, false AS cycle FROM nation WHERE n_nationkey > 0
UNION ALL SELECT root, depth + 1, b, list_append(path, b), list_contains(path, b) AND b <> 0 FROM w JOIN e ON node = a WHERE depth < 2 AND NOT cycle)"""


def _tree(spark, d):
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    edges = nation.select("a", F.explode(F.array(F.lit(1), F.lit(5), F.lit(9))).alias("k")).select(F.col("a").alias("src"), ((F.col("a") * 7 + F.col("k")) % 25).alias("dst"), F.lit(2).alias("rank"), F.lit(1).alias("line")).distinct()
    return graph.traverse(nation.where("a > 0").select(F.col("a").alias("node")), edges, depth=2)


@_query(_TREE + " SELECT root, depth, node, array_to_string(path, '>') AS path FROM w WHERE EXISTS (SELECT 1 FROM w v WHERE v.root = w.root AND v.node % 6 = 0 AND v.path[1:len(w.path)] = w.path)")
def GR10_towards_tests(spark, d):
    return graph.towards(_tree(spark, d), F.col("node") % 6 == 0).select("root", "depth", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@_query(_TREE + " SELECT root, count(DISTINCT node) FILTER (depth = 1)::BIGINT AS direct, count(DISTINCT node)::BIGINT AS transitive, count(DISTINCT node % 4)::BIGINT AS files, count(DISTINCT node) FILTER (node % 6 = 0)::BIGINT AS tests FROM w WHERE depth > 0 GROUP BY 1")
def GR12_blast_radius(spark, d):
    decls = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 4).alias("path_name"), (F.col("n_nationkey") % 6 == 0).alias("is_test"))
    return graph.blast_radius(_tree(spark, d), decls).select("root", "direct", "transitive", "files", "tests")
