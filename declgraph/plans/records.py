"""Records of declarations and their text forms: directives split by what they are for, one line, folded, Markdown.

Each form is one string expression over a record's columns, so it is made where the rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Directives that state a contract, and those that tell a story.
INVARIANT_TAGS = ("ai:invariant", "ai:requires", "ai:warn", "ai:spec")
SUMMARY_TAGS = ("ai:why", "ai:example", "ai:see", "ai:depends", "ai:prompt", "ai:section")

_NO_LINES = "array<string>"


def split_directives(directives: DataFrame) -> DataFrame:
    """decl_id, invariants and summary (arrays of line, tag, value in order of line), directive_count."""
    def of(tags: tuple[str, ...]) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("tag").isin(*tags), F.struct("line", "tag", "value"))))

    return directives.groupBy("decl_id").agg(of(INVARIANT_TAGS).alias("invariants"), of(SUMMARY_TAGS).alias("summary"), F.count("*").alias("directive_count"))


def records(decls: DataFrame, docs: DataFrame, directives: DataFrame) -> DataFrame:
    """decls (with file_path) with doc, doc_lines, invariants, summary and directive_count; absent ones are empty."""
    texts = docs.select(F.col("decl_id").alias("id"), F.col("text").alias("doc"))
    tags = split_directives(directives).withColumnRenamed("decl_id", "id")
    none = F.array().cast("array<struct<line:int,tag:string,value:string>>")
    rows = decls.join(texts, "id", "left").join(tags, "id", "left")
    filled = {c: F.coalesce(F.col(c).cast("array<struct<line:int,tag:string,value:string>>"), none) for c in ("invariants", "summary")}
    return rows.withColumns({**filled, "directive_count": F.coalesce("directive_count", F.lit(0)), "doc_lines": F.when(F.col("doc").isNotNull(), tx.lines_with_text(F.col("doc")))})


def one_line(spi: str = "spi") -> Column:
    """id TAB kind TAB container TAB file:line, and the system interface groups, if any."""
    groups = F.when(F.size(spi) > 0, F.concat(F.lit("\t@_spi("), F.array_join(spi, ","), F.lit(")"))).otherwise("")
    return F.concat(F.concat_ws("\t", "decl_id", "kind", F.coalesce("container", F.lit("-")), F.concat_ws(":", "file_path", F.col("start_line").cast("string"))), groups)


def _lines(*parts: Column) -> Column:
    """Lines of single strings (null: none) and of arrays of them."""
    return F.array_join(F.flatten(F.array(*parts)), "\n")


def _one(line: Column) -> Column:
    return F.when(line.isNull(), F.array().cast(_NO_LINES)).otherwise(F.array(line))


def _each(rows: Column, line) -> Column:
    return F.coalesce(F.transform(rows, line), F.array().cast(_NO_LINES))


def _doc_lines(doc: Column) -> Column:
    return F.coalesce(F.filter(F.split(doc, r"\r\n|\r|\n", -1), lambda x: x != ""), F.array().cast(_NO_LINES))


def folded(body: Column | None = None) -> Column:
    """Comment lines on what the declaration is, its docs and directives, then the signature and a body, if given."""
    place = F.format_string("// %s  %s:%d-%d", "kind", "file_path", "start_line", "end_line")
    spi = F.when(F.size("spi") > 0, F.concat(F.lit("// @_spi: "), F.array_join("spi", ", ")))
    count = lambda label, c: _one(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"// {label}: "), F.col(c).cast("string"))))
    comment = lambda x: F.concat(F.lit("// "), x)
    tagged = lambda d: F.concat(F.lit("// "), d["tag"], F.lit(": "), d["value"])
    docs = F.transform(_doc_lines(F.col("doc")), comment)
    return _lines(_one(place), _one(spi), count("doc_lines", "doc_lines"), count("directives", "directive_count"), docs, _each(F.col("summary"), tagged), _each(F.col("invariants"), tagged), _one(F.col("signature")), _one(F.lit(None).cast("string") if body is None else body))


def markdown(body: Column | None = None) -> Column:
    """A heading, the place, signature, docs, directives as a list, and a body in a fence, if given."""
    head = F.concat(F.lit("### `"), "decl_id", F.lit("`"))
    place = F.format_string("_%s · %s:%d-%d_", "kind", "file_path", "start_line", "end_line")
    spi = F.when(F.size("spi") > 0, F.concat(F.lit("**@_spi:** "), F.array_join("spi", ", ")))
    tagged = lambda d: F.concat(F.lit("- **"), d["tag"], F.lit(":** "), d["value"])
    signature = F.concat(F.lit("`"), "signature", F.lit("`"))
    fence = F.lit(None).cast("string") if body is None else F.concat(F.lit("```swift\n"), body, F.lit("\n```"))
    return _lines(_one(head), _one(place), _one(spi), _one(signature), _one(F.nullif(F.col("doc"), F.lit(""))), _each(F.col("summary"), tagged), _each(F.col("invariants"), tagged), _one(fence))


def capped(items: Column, limit: int = 8) -> Column:
    """Items in a row, at most `limit` of them and how many more there are."""
    shown = F.array_join(F.slice(items, 1, limit), ", ")
    return F.when(F.size(items) > limit, F.concat(shown, F.lit(", +"), (F.size(items) - limit).cast("string"), F.lit(" more"))).otherwise(shown)
