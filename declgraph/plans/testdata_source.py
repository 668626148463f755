"""Extraction over the driver's tables: every supplier is written out as a source file, so that SQL over suppliers tells what the
file declares, imports, calls and binds. Also statements as users of an embedded database write them, over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sqltext
from ..index import extract, tables_of
from .testdata import _query, _t

#: {k} is the supplier, {n} its nation, {a} an access level, {t} a kind of type.
_SOURCE = r"""import Foundation
@testable import struct M{n}.Thing
@_spi(G{n}) import N{n}
/// Says {k}.
//# ai:section: s{n}
{a} {t} T{k}: P{n}, Q {
    private var a{k}: Int = {k}
    let b{k}, c{k}: String
    func f{n}(x: T{n}?, _ y: [Int], p: any P{n}) async throws -> Int { x.g{k}(); let z = T{n}(); func inner() { z.no() }; self.h(z.k); return z.h{n}() }
    public init(v: Int) { a{k} = v }
    subscript(i: Int) -> Int { get { i } }
    deinit {}
    typealias E{k} = Int
    struct In{k} { let s = "func fake{k}() \(m{k}(1))" }
}
enum K{k}: Int { case one{k}, two
 case three }
protocol R{k}: P{n} { associatedtype A{k}
 func req{k}()
 subscript(i: Int) -> Int { get } }
@_spi(G2) extension T{k} { func more{k}() {} }
infix operator <+>: AdditionPrecedence
precedencegroup Pg{k} { higherThan: AdditionPrecedence }
"""
_ACCESS, _TYPE = ("public", "internal", "fileprivate"), ("class", "struct", "actor")
_S = "s AS (SELECT s_suppkey AS k, s_nationkey AS n, CASE s_suppkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'fileprivate' END AS a, CASE s_nationkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'struct' ELSE 'actor' END AS t FROM supplier)"


def _rows(names: str, *rows: tuple[str, ...]) -> str:
    """One SELECT for each row that a supplier's file gives; {k} and {n} stand for the supplier's in texts."""
    filled = lambda e: "'" + e[1:-1].replace("{k}", "' || k || '").replace("{n}", "' || n || '") + "'" if e[:1] == "'" else e
    columns = names.split()
    return f"WITH {_S} " + " UNION ALL ".join("SELECT k, " + ", ".join(f"{filled(e)} AS {c}" for e, c in zip(r, columns, strict=True)) + " FROM s" for r in rows)


def _files(spark, d) -> DataFrame:
    """(k, path, content) of every supplier. A table of short rows may be read by one task, so they are dealt to all before they
    become files."""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    s = s.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    fill = {"{k}": F.col("k").cast("string"), "{n}": F.col("n").cast("string"), "{a}": F.element_at(F.array(*map(F.lit, _ACCESS)), (F.col("k") % 3 + 1).cast("int")), "{t}": F.element_at(F.array(*map(F.lit, _TYPE)), (F.col("n") % 3 + 1).cast("int"))}
    text = F.lit(_SOURCE)
    for name, value in fill.items():
        text = F.replace(text, F.lit(name), value)
    return s.select("k", F.concat(F.lit("Sources/S"), F.col("k"), F.lit(".swift")).alias("path"), text.cast("binary").alias("content"))


def _tables(spark, d) -> dict[str, DataFrame]:
    """The tables of all files; those with a file_id have k for it."""
    files = _files(spark, d)
    told = files.select("path", F.lit(0.0).alias("mtime"), F.lit("").alias("sha256"), F.length("content").cast("long").alias("bytes"))
    of = files.select("k", F.xxhash64("path").alias("file_id"))
    found = tables_of(told, extract(files))
    return {name: df.join(of, "file_id").drop("file_id") if "file_id" in df.columns else df for name, df in found.items()}


def _decls(spark, d, *kinds: str) -> DataFrame:
    df = _tables(spark, d)["declarations"]
    return df.where(F.col("kind").isin(*kinds)) if kinds else df


_TYPES = [("'T{k}'", "t", "NULL", "a", "6", "15"), ("'T{k}.In{k}'", "'struct'", "'T{k}'", "NULL", "14", "14"), ("'K{k}'", "'enum'", "NULL", "NULL", "16", "17"), ("'R{k}'", "'protocol'", "NULL", "NULL", "18", "20"), ("'T{k}'", "'extension'", "NULL", "NULL", "21", "21")]


@_query(_rows("decl_id kind container access start_line end_line", *_TYPES))
def EX01_types(spark, d):
    return _decls(spark, d, "struct", "class", "actor", "enum", "protocol", "extension").select("k", "decl_id", "kind", "container", "access", "start_line", "end_line")


@_query(_rows("decl_id signature modifiers", ("'T{k}.f{n}(x:T{n}?,_:[Int],p:anyP{n})'", "'func f{n}(x: T{n}?, _ y: [Int], p: any P{n}) async throws -> Int'", "'async throws'"), ("'T{k}.init(v:Int)'", "'public init(v: Int)'", "'public'"), ("'R{k}.req{k}()'", "'func req{k}()'", "''"), ("'T{k}.more{k}()'", "'func more{k}()'", "''")))
def EX02_functions(spark, d):
    return _decls(spark, d, "func", "init").select("k", "decl_id", "signature", F.array_join("modifiers", " ").alias("modifiers"))


@_query(_rows("decl_id kind signature", ("'T{k}.subscript(i:Int)'", "'subscript'", "'subscript(i: Int) -> Int'"), ("'R{k}.subscript(i:Int)'", "'subscript'", "'subscript(i: Int) -> Int { get }'"), ("'T{k}.deinit'", "'deinit'", "'deinit'")))
def EX03_subscripts(spark, d):
    return _decls(spark, d, "subscript", "deinit").select("k", "decl_id", "kind", "signature")


@_query(_rows("decl_id kind container", ("'<+>'", "'operator'", "NULL"), ("'Pg{k}'", "'precedencegroup'", "NULL"), ("'R{k}.A{k}'", "'associatedtype'", "'R{k}'"), ("'T{k}.E{k}'", "'typealias'", "'T{k}'")))
def EX04_other_declarations(spark, d):
    return _decls(spark, d, "operator", "precedencegroup", "associatedtype", "typealias").select("k", "decl_id", "kind", "container")


_VARIABLES = [("'T{k}.a{k}'", "'var'", "'private var a{k}: Int = {k}'", "7"), ("'T{k}.b{k}'", "'let'", "'let b{k}, c{k}: String'", "8"), ("'T{k}.c{k}'", "'let'", "'let b{k}, c{k}: String'", "8")]


@_query(_rows("decl_id kind signature start_line", *_VARIABLES))
def EX05_variables(spark, d):
    return _decls(spark, d, "var", "let").where("name <> 's'").select("k", "decl_id", "kind", "signature", "start_line")


@_query(_rows("decl_id signature start_line", ("'K{k}.one{k}'", "'case one{k}'", "16"), ("'K{k}.two'", "'case two'", "16"), ("'K{k}.three'", "'case three'", "17")))
def EX06_cases(spark, d):
    return _decls(spark, d, "case").select("k", "decl_id", "signature", "start_line")


@_query(_rows("module path kind spi testable line", ("'Foundation'", "'Foundation'", "NULL", "''", "false", "1"), ("'M{n}'", "'M{n}.Thing'", "'struct'", "''", "true", "2"), ("'N{n}'", "'N{n}'", "NULL", "'G{n}'", "false", "3")))
def EX07_imports(spark, d):
    return _tables(spark, d)["imports"].select("k", "module", "path", "kind", F.array_join("spi", ",").alias("spi"), "testable", "line")


@_query(_rows("decl_id kind spi", ("'T{k}'", "'extension'", "'G2'"), ("'T{k}.more{k}()'", "'func'", "'G2'")))
def EX08_spi(spark, d):
    return _decls(spark, d).where(F.size("spi") > 0).select("k", "decl_id", "kind", F.array_join("spi", ",").alias("spi"))


@_query(f"WITH {_S} SELECT k, 'T' || k AS decl_id, 'Says ' || k || '.' AS doc, 'ai:section' AS tag, 's' || n AS value, 5 AS line FROM s")
def EX09_docs_and_directives(spark, d):
    t = _tables(spark, d)
    doc = t["doc_comments"].select(F.col("decl_id").alias("id"), F.col("text").alias("doc"))
    tags = t["directives"].select(F.col("decl_id").alias("id"), "tag", "value", "line")
    return t["declarations"].select("k", "id", "decl_id").join(doc, "id").join(tags, "id").select("k", "decl_id", "doc", "tag", "value", "line")


@_query(f"WITH {_S} SELECT k, access, count(*)::BIGINT AS n FROM (SELECT k, unnest([a, 'private', 'public']) AS access FROM s) GROUP BY 1, 2")
def EX10_access(spark, d):
    return _decls(spark, d).where("access is not null").groupBy("k", "access").agg(F.count("*").alias("n"))


@_query(f"WITH {_S} SELECT k, 23::BIGINT AS declarations, 0::BIGINT AS of_bodies FROM s")
def EX11_bodies_declare_nothing(spark, d):
    inner = F.count_if(F.col("name").isin("inner", "z", "no"))
    return _decls(spark, d).groupBy("k").agg(F.count("*").alias("declarations"), inner.alias("of_bodies"))


_CALLS = [("'g{k}'", "'x'", "9"), ("'T{n}'", "NULL", "9"), ("'no'", "'z'", "9"), ("'h'", "'self'", "9"), ("'h{n}'", "'z'", "9"), ("'m{k}'", "NULL", "14")]


@_query(_rows("name receiver line", *_CALLS))
def EX12_calls(spark, d):
    return _tables(spark, d)["call_sites"].where("kind = 'call'").select("k", "name", "receiver", "line")


@_query(_rows("name line", ("'x'", "9"), ("'y'", "9"), ("'p'", "9"), ("'z'", "9"), ("'v'", "10"), ("'i'", "11"), ("'i'", "20")))
def EX13_bindings(spark, d):
    return _tables(spark, d)["bindings"].select("k", "name", "line")


@_query(_rows("name type", ("'x'", "'T{n}'"), ("'y'", "'Array'"), ("'p'", "'P{n}'")))
def EX14_peeled_types(spark, d):
    return _tables(spark, d)["bindings"].where("name in ('x', 'y', 'p')").select("k", "name", "type")


@_query(_rows("name type", ("'z'", "'T{n}'")))
def EX15_constructed_types(spark, d):
    return _tables(spark, d)["bindings"].where("name = 'z'").select("k", "name", "type")


@_query(_rows("type_name protocol_name", ("'T{k}'", "'P{n}'"), ("'T{k}'", "'Q'"), ("'K{k}'", "'Int'"), ("'R{k}'", "'P{n}'")))
def EX16_conformances(spark, d):
    return _tables(spark, d)["conformances"].select("k", "type_name", "protocol_name")


@_query(f"WITH {_S} SELECT k, 0::BIGINT AS fakes, 1::BIGINT AS interpolated FROM s")
def EX17_strings(spark, d):
    """What a string holds is no declaration; what it interpolates is a call."""
    t = _tables(spark, d)
    fakes = t["declarations"].groupBy("k").agg(F.count_if(F.col("name").startswith("fake")).alias("fakes"))
    calls = t["call_sites"].where(F.col("name").rlike("^m[0-9]+$")).groupBy("k").agg(F.count("*").alias("interpolated"))
    return fakes.join(calls, "k")


@_query(_rows("name owner", ("'g{k}'", "'T{k}.f{n}(x:T{n}?,_:[Int],p:anyP{n})'"), ("'T{n}'", "'T{k}.f{n}(x:T{n}?,_:[Int],p:anyP{n})'"), ("'no'", "'T{k}.f{n}(x:T{n}?,_:[Int],p:anyP{n})'"), ("'h'", "'T{k}.f{n}(x:T{n}?,_:[Int],p:anyP{n})'"), ("'h{n}'", "'T{k}.f{n}(x:T{n}?,_:[Int],p:anyP{n})'"), ("'m{k}'", "'T{k}.In{k}.s'")))
def EX18_owners(spark, d):
    t = _tables(spark, d)
    owners = t["declarations"].select(F.col("id").alias("from_decl"), F.col("decl_id").alias("owner"))
    return t["call_sites"].where("kind = 'call'").join(owners, "from_decl").select("k", "name", "owner")


@_query(f"WITH {_S} SELECT k, CASE WHEN k % 2 = 0 THEN 24 ELSE 23 END::BIGINT AS declarations FROM s")
def SC06_broken_files(spark, d):
    """A stray brace and an open one at the end of every second file lose none of its declarations, and one declaration more is there."""
    files = _files(spark, d).withColumn("content", F.when(F.col("k") % 2 == 0, F.concat(F.col("content"), F.lit(b"}\nfunc late() { if x {\n"))).otherwise(F.col("content")))
    of = files.select("k", F.xxhash64("path").alias("file_id"))
    told = files.select("path", F.lit(0.0).alias("mtime"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("bytes"))
    return tables_of(told, extract(files))["declarations"].join(of, "file_id").groupBy("k").agg(F.count("*").alias("declarations"))


# --- statements of users


def _sql(spark, d, text: str, **views: str) -> DataFrame:
    for name in views.values() or ():
        _t(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sqltext.to_spark(text))


@_query("SELECT p_partkey, p_name FROM part WHERE lower(p_type) LIKE '%brass%' OR p_name ILIKE 'RED%'")
def SQ01_like_any_case(spark, d):
    return _sql(spark, d, "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE 'red%'", t="part")


@_query("SELECT o_custkey % 10 AS bucket, (count(*) // 7)::DOUBLE AS sevenths FROM orders GROUP BY 1")
def SQ02_whole_division(spark, d):
    return _sql(spark, d, "SELECT o_custkey % 10 AS bucket, count(*) / 7 AS sevenths FROM orders GROUP BY 1", t="orders")


@_query("SELECT doc_id, length(text)::BIGINT AS n, substr(text, 2, 5) AS part, instr(text, 'the')::BIGINT AS at_ FROM documents WHERE text IS NOT NULL")
def SQ03_text_functions(spark, d):
    return _sql(spark, d, "SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS n, SUBSTR(text, 2, 5) AS part, CAST(INSTR(text, 'the') AS BIGINT) AS at_ FROM documents WHERE text IS NOT NULL", t="documents")


@_query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM (SELECT * FROM nation WHERE n_nationkey = n_regionkey OR n_nationkey % 25 = 24) GROUP BY 1 HAVING count(*) = 1")
def SQ04_group_concat(spark, d):
    return _sql(spark, d, "SELECT n_regionkey, group_concat(n_name) AS names FROM nation WHERE n_nationkey = n_regionkey OR n_nationkey % 25 = 24 GROUP BY n_regionkey HAVING count(*) = 1", t="nation")


@_query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '-') AS a, CASE WHEN p_size > 9 THEN 'large' ELSE 'small' END AS b, greatest(p_size, 20)::BIGINT AS c, least(p_size, 20)::BIGINT AS d FROM part")
def SQ05_choices(spark, d):
    return _sql(spark, d, "SELECT p_partkey, IFNULL(CASE WHEN p_size > 25 THEN p_brand END, '-') AS a, IIF(p_size > 9, 'large', 'small') AS b, CAST(MAX(p_size, 20) AS BIGINT) AS c, CAST(MIN(p_size, 20) AS BIGINT) AS d FROM part", t="part")


@_query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https://.*/en/.*$')")
def SQ06_glob(spark, d):
    return _sql(spark, d, "SELECT page_id FROM pages WHERE url GLOB 'https://*/en/*'", t="pages")


@_query("SELECT c_nationkey, arg_max(c_custkey, c_custkey) AS c_custkey, max(c_custkey) AS latest FROM customer GROUP BY 1")
def SQ07_bare_columns(spark, d):
    return _sql(spark, d, "SELECT c_nationkey, c_custkey, max(c_custkey) AS latest FROM customer GROUP BY c_nationkey", t="customer")


@_query("WITH RECURSIVE w AS (SELECT n_nationkey::BIGINT AS n, 0 AS step FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n + 5, step + 1 FROM w WHERE step < 3) SELECT w.n, w.step, n_name FROM w JOIN nation ON n_nationkey = w.n")
def SQ08_recursive(spark, d):
    return _sql(spark, d, "WITH RECURSIVE w(n, step) AS (SELECT CAST(n_nationkey AS BIGINT), 0 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n + 5, step + 1 FROM w WHERE step < 3) SELECT w.n, w.step, n_name FROM w JOIN nation ON n_nationkey = w.n", t="nation")


@_query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS at_ FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) EXCEPT SELECT o_custkey, o_orderkey, 1 FROM orders")
def SQ09_windows_and_sets(spark, d):
    return _sql(spark, d, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS at_ FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) EXCEPT SELECT o_custkey, o_orderkey, 1 FROM orders", t="orders", u="customer")
