"""Scalar functions over text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def type_names(text: Column) -> Column:
    """Words of ASCII letters, digits and _ that begin with A-Z, each once, in the order they appear."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]*(?![A-Za-z0-9_])"), F.lit(0)))


def unicode_type_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])\p{Lu}[\p{L}\p{N}_]*"), F.lit(0)))


def module_of(path: Column, root: str) -> Column:
    """First segment under the source root; - elsewhere."""
    under = F.regexp_extract(path, f"^{root}/([^/]+)/", 1)
    return F.when(under == "", F.lit("-")).otherwise(under)


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def header(signature: Column, kind: Column, has_body: Column) -> Column:
    """The signature up to a body: of a variable or subscript with a body what is before the brace; of a variable of several
    lines what is before the value, with = ..., or else the first line with ...; any other signature as it is."""
    variable = kind.isin("var", "let")
    cut = F.trim(F.substring_index(signature, "{", 1))
    value = F.concat(F.trim(F.substring_index(signature, "=", 1)), F.lit(" = ..."))
    first = F.concat(F.try_element_at(F.filter(F.split(signature, r"\r\n|\r|\n"), lambda x: x != ""), F.lit(1)), F.lit(" ..."))
    several = variable & signature.rlike(r"[\r\n]")
    return F.when((variable | (kind == "subscript")) & has_body & signature.contains("{"), cut).when(several & signature.contains("="), value).when(several, first).otherwise(signature)


def accessors(signature: Column, kind: Column) -> Column:
    """{ get set } and the like: the block of a variable or subscript that holds nothing but accessor words; null otherwise."""
    # fixed values: accessor and effect words
    known = ("get", "set", "async", "throws", "nonmutating", "mutating")
    block = F.regexp_extract(signature, r"(?s)\{(.*)\}", 1)
    words = F.filter(F.split(block, r"[\s,]+"), lambda x: x != "")
    ok = kind.isin("var", "let", "subscript") & (F.size(words) > 0) & F.forall(words, lambda x: x.isin(*known))
    return F.when(ok, F.concat(F.lit("{ "), F.array_join(words, " "), F.lit(" }")))


def lines_with_text(text: Column) -> Column:
    """Number of lines that are not empty."""
    return F.size(F.filter(F.split(text, r"\r\n|\r|\n", -1), lambda x: x != ""))


def lines(text: Column) -> Column:
    """All lines, empty ones too."""
    return F.split(text, r"\r\n|\r|\n", -1)


def line_range(of: Column, wanted: str | None) -> Column:
    """a-b: lines a to b, counted from 1 and held to what there is; -n: the last n; anything else, or nothing in it: all."""
    if wanted and re.fullmatch(r"-\d+", wanted):
        n = int(wanted[1:])
        return F.slice(of, F.greatest(F.size(of) - n + 1, F.lit(1)), n) if n else F.slice(of, 1, 0)
    found = re.fullmatch(r"(\d+)-(\d+)", wanted or "")
    if not found:
        return of
    low, high = max(1, int(found[1])), int(found[2])
    if high < low:
        return of
    return F.when(F.size(of) >= low, F.slice(of, low, high - low + 1)).otherwise(of)


def below(path: Column, root: str) -> Column:
    """A path relative to a root that it lies under; empty for the root itself; unchanged elsewhere."""
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).when(path == root, "").otherwise(path)


def undecorated(line: Column) -> Column:
    """A comment line without its slashes or stars."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^(///?|/\*\*?|\*(?!/))", ""), r"\*/$", "")
    return F.trim(bare)


def reindented(text: Column, indent: str) -> Column:
    """A slice of source under another indent: the first line begins there, the others keep what they have beyond their common
    indent, blank lines become empty."""
    each = F.split(text, "\n", -1)
    rest = F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0)))
    spaces = lambda x: F.length(x) - F.length(F.ltrim(x))
    common = F.coalesce(F.array_min(F.transform(F.filter(rest, lambda x: F.trim(x) != ""), spaces)), F.lit(0))
    first = F.concat(F.lit(indent), F.trim(each[0]))
    moved = F.transform(rest, lambda x: F.when(F.trim(x) == "", "").otherwise(F.concat(F.lit(indent), F.substring(x, common + 1, F.length(x)))))
    return F.array_join(F.concat(F.array(first), moved), "\n")


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")


def name_offset(text: Column, name: str) -> Column:
    """Byte offset of the first whole-word occurrence of a name; null without one."""
    before = F.regexp_extract(text, rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}_$]){re.escape(name)}(?![\p{{L}}\p{{N}}_$])", 1)
    return F.when(text.rlike(rf"(?<![\p{{L}}\p{{N}}_$]){re.escape(name)}(?![\p{{L}}\p{{N}}_$])"), F.octet_length(before).cast("long"))


def last_indent(text: Column) -> Column:
    """How many blanks the last line begins with."""
    return F.length(F.regexp_extract(F.substring_index(text, "\n", -1), r"^[ \t]*", 0))


def comment_lines_above(text: Column) -> Column:
    """How many comment lines stand directly above the last line."""
    each = F.reverse(F.split(text, "\n", -1))
    comment = F.transform(F.slice(each, 2, F.greatest(F.size(each) - 1, F.lit(0))), lambda x: F.trim(x).rlike(r"^(//|\*|/\*)"))
    first = F.array_position(comment, F.lit(False))
    return F.when(first == 0, F.size(comment)).otherwise(first - 1).cast("int")


def iso(at: Column) -> Column:
    """A time as ISO 8601 in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 time; null for what is none."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def byte_slice(content: Column, offset: Column, length: Column) -> Column:
    """length bytes from an offset (from 0), held to the content's end; null if they are not UTF-8."""
    part = F.substring(content, (offset + 1).cast("int"), length.cast("int"))
    return F.when(F.call_function("is_valid_utf8", part.cast("string")), part.cast("string"))


def size_label(n: Column) -> Column:
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.format_string("%.1f KB", n / 1000.0))


def percent_label(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def directive(line: Column) -> Column:
    """tag and value of an inline directive line, both null otherwise; the value is trimmed, quotes stay."""
    shape = r"^\s*//#\s*(ai:[\p{L}\p{N}_]+)(?:\s*:\s*(.*?))?\s*$"
    tag = F.regexp_extract(line, shape, 1)
    return F.struct(F.nullif(tag, F.lit("")).alias("tag"), F.when(tag != "", F.regexp_extract(line, shape, 2)).alias("value"))


def renamed_path(path: Column) -> Column:
    """The new path of `a => b`, `d/{a => b}/f` and `{a => b}/f`."""
    braced = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    plain = F.regexp_replace(braced, r"^.* => ", "")
    return F.regexp_replace(F.regexp_replace(plain, "//", "/"), "^/", "")


def under_prefix(path: Column, prefix: str) -> Column:
    """A repository path as the index has it; null outside the prefix."""
    return path if not prefix else F.when(path.startswith(prefix + "/"), F.substring(path, len(prefix) + 2, 1 << 30))


def index_prefix(path: Column, prefix: str) -> Column:
    return path if not prefix else F.concat(F.lit(prefix + "/"), path)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def before_bracket(decl_id: Column) -> Column:
    return F.substring_index(decl_id, "(", 1)
