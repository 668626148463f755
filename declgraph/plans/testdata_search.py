"""Substring lookup over the driver's tables: words of documents and names of parts by the pieces they are made of."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pieces, ranks
from .testdata import _query, _t

_HELD = "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents"


#: Pairs of a needle and a word (some tens of bytes each) up to which they are broadcast to the texts; more are met by shuffle.
MOST_PAIRS = 2_000_000


def _held(spark, d) -> DataFrame:
    """(doc_id, word), each once in a row of documents."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0)))
    return _t(spark, d, "documents").select("doc_id", F.explode(words).alias("word"))


def _asked(spark, d) -> DataFrame:
    """needle: what users look for, from one character on: words of parts' names, and beginnings of nations' names."""
    name = F.col("n_name")
    nations = _t(spark, d, "nation").select(F.explode(F.array(F.substring(name, 1, 1), F.substring(name, 1, 2), F.substring(name, 1, 3), F.substring(name, 2, 4))).alias("needle"))
    return nations.unionByName(_t(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("needle"))).distinct()


_ASKED = "SELECT DISTINCT needle FROM (SELECT unnest([n_name[1:1], n_name[1:2], n_name[1:3], n_name[2:5]]) AS needle FROM nation UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part) WHERE needle <> ''"


@_query(f"WITH h AS ({_HELD}), w AS (SELECT DISTINCT word FROM h), a AS ({_ASKED}), m AS (SELECT needle, word FROM a JOIN w ON contains(lower(word), lower(needle))) SELECT needle, count(DISTINCT word)::BIGINT AS words, count(DISTINCT doc_id)::BIGINT AS docs FROM m JOIN h USING (word) GROUP BY 1")
def FL04_words_holding(spark, d):
    """Needles meet the words of all texts; documents are counted as bits of 64 ids each, so what a task holds is neither pairs
    of a needle and a document nor their words."""
    held = _held(spark, d)
    found = pieces.posted(held, "word")
    met = pieces.holding(_asked(spark, d), found, pieces.counted(found)).persist(StorageLevel.DISK_ONLY)
    few = met.limit(MOST_PAIRS + 1).count() <= MOST_PAIRS
    needles = met.groupBy(F.col("term").alias("word")).agg(F.collect_list("needle").alias("needles"))
    at = held.where("doc_id is not null").join(F.broadcast(needles) if few else needles, "word").select(F.explode("needles").alias("needle"), "doc_id")
    bit = F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    blocks = at.groupBy("needle", F.shiftright("doc_id", 6).alias("block")).agg(F.bit_or(bit).alias("ids"))
    docs = blocks.groupBy("needle").agg(F.sum(F.bit_count("ids")).alias("docs"))
    words = met.groupBy("needle").agg(F.count("*").alias("words"))
    return words.join(docs, "needle", "left").select("needle", "words", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"))


_PARTS = "SELECT p_partkey AS id, p_brand || '.' || p_name AS decl_id, p_name AS name FROM part"


@_query(f"SELECT needle, id FROM ({_ASKED}) JOIN ({_PARTS}) ON contains(lower(decl_id), lower(needle)) OR contains(lower(name), lower(needle)) WHERE length(needle) >= 3")
def FL05_declarations_holding(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("."), "p_name").alias("decl_id"), F.col("p_name").alias("name"))
    terms = parts.select("id", F.explode(F.array("decl_id", "name")).alias("term")).distinct()
    found = pieces.posted(terms)
    return pieces.holding(_asked(spark, d).where("length(needle) >= 3"), found, pieces.counted(found)).join(terms, "term").select("needle", "id").distinct()


_LADDER = f"SELECT needle, id, CASE WHEN decl_id = needle THEN 0 WHEN lower(name) = lower(needle) THEN 1 ELSE 2 END AS rung FROM ({_ASKED}) JOIN ({_PARTS}) ON contains(lower(decl_id), lower(needle))"


@_query(f"WITH r AS ({_LADDER}) SELECT needle, id, rung FROM r WHERE rung = (SELECT min(rung) FROM r AS b WHERE b.needle = r.needle)")
def FL12_ladders_of_many(spark, d):
    """The call graph's ladder for many queries at once: exact id, name in any case, id that holds the query."""
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("."), "p_name").alias("decl_id"), F.col("p_name").alias("name"))
    found = pieces.posted(parts, "decl_id")
    met = pieces.holding(_asked(spark, d), found, pieces.counted(found)).withColumnRenamed("term", "decl_id").join(parts, "decl_id")
    rung = F.when(F.col("decl_id") == F.col("needle"), 0).when(F.lower("name") == F.lower("needle"), 1).otherwise(2)
    ranked = met.select("needle", "id", rung.alias("rung"))
    best = ranked.groupBy("needle").agg(F.min("rung").alias("rung"))
    return ranked.join(best, ["needle", "rung"], "left_semi").select("needle", "id", "rung")


_SEEN = "SELECT arg_max(o_orderdate, o_orderkey) AS d, max(o_orderkey) AS k FROM orders"


@_query(f"SELECT o_orderkey, o_totalprice FROM orders, ({_SEEN}) WHERE o_orderdate > d OR (o_orderdate = d AND o_orderkey > k) ORDER BY o_orderdate, o_orderkey LIMIT 500")
def TK02_page_after(spark, d):
    """The page that follows the order of the highest number, sought by its key."""
    orders = _t(spark, d, "orders")
    last = orders.agg(F.max(F.struct("o_orderkey", "o_orderdate")).alias("s")).first().s
    return ranks.after(orders, {"o_orderdate": last.o_orderdate, "o_orderkey": last.o_orderkey}, 500).select("o_orderkey", "o_totalprice")
