"""Predicates: path scopes, globs, ignore rules, names, access floors, groups of system interface, tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ACCESS, normal_access


def in_path(path: Column, scope: str) -> Column:
    """The path itself or what lies under it (exact prefix; no wildcards, case matters)."""
    scope = scope.rstrip("/")
    return F.lit(True) if scope in ("", ".") else (path == scope) | path.startswith(scope + "/")


def in_path_or_named(path: Column, scope: str) -> Column:
    """As in_path, or a path that ends in /scope."""
    return in_path(path, scope) | path.endswith("/" + scope.rstrip("/"))


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: * and ? stay within a segment, ** does not, [abc] [a-z] [!abc] are classes.
    **/ stands for any characters, so what follows may begin inside a segment."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".*")
            i += 3 if pattern.startswith("**/", i) else 2
            continue
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if close > 0:
            inner = pattern[i + 1 : close]
            out.append(f"[{'^' if inner[0] == '!' else ''}{re.escape(inner.lstrip('!')).replace(chr(92) + '-', '-')}]")
            i = close + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike("(?s)" + glob_to_regex(pattern))


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules (in the order of the file) drop a path. The last rule that fits wins; ! brings back; a leading
    slash anchors; a trailing one means directories only. A dropped directory takes all below it with it for good."""
    parsed = []
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        only_dirs, anchored, body = rule.endswith("/"), rule.startswith("/"), rule.strip("/")
        patterns = [body] if anchored else [body, f"**/{body}"]
        parsed.append((keep, only_dirs, "|".join(glob_to_regex(p) for p in patterns)))
    steps = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))

    def dropped(part: Column, is_dir: Column) -> Column:
        state = F.lit(False)
        for keep, only_dirs, regex in parsed:
            fits = part.rlike(regex) & (is_dir if only_dirs else F.lit(True))
            state = F.when(fits, F.lit(not keep)).otherwise(state)
        return state

    return F.exists(above, lambda part: dropped(part, part != path))


def name_like(name: Column, text: str) -> Column:
    """Holds text, whatever the case."""
    return F.lower(name).contains(text.lower())


def id_or_name_like(decl_id: Column, name: Column, text: str) -> Column:
    return F.lower(decl_id).contains(text.lower()) | F.lower(name).contains(text.lower())


def access_floor(access: Column, least: str) -> Column:
    """At least as open as `least`; unknown access is internal."""
    return normal_access(access).isin(*ACCESS[: ACCESS.index(least) + 1])


def spi_is(groups: Column, wanted: str) -> Column:
    """any: in some group; none: in none; else in the named one. groups: an array."""
    if wanted == "any":
        return F.size(groups) > 0
    return F.coalesce(F.size(groups), F.lit(0)) <= 0 if wanted == "none" else F.array_contains(groups, wanted)


def spi_text_is(groups: Column, wanted: str) -> Column:
    """The same over a comma-joined column, for whole names only."""
    text = F.coalesce(groups, F.lit(""))
    if wanted in ("any", "none"):
        return (text != "") if wanted == "any" else (text == "")
    return F.concat(F.lit(","), text, F.lit(",")).contains(f",{wanted},")


def is_test_path(path: Column) -> Column:
    """A segment is Tests or ends in Tests."""
    return path.rlike("(^|/)[^/]*Tests(/|$)")


def is_test(path: Column, container: Column) -> Column:
    return is_test_path(path) | F.coalesce(container.rlike("(Tests|TestCase)$"), F.lit(False))


def with_tag(df: DataFrame, tags: DataFrame, tag: str, on: str, tag_on: str, value: str | None = None) -> DataFrame:
    """Rows that carry a tag (with a value): a semi join."""
    t = tags.where(F.col("tag") == tag)
    t = t if value is None else t.where(F.col("value") == value)
    return df.join(t.select(F.col(tag_on).alias(on)), on, "left_semi")


def kept_by_pattern(decl_id: Column, name: Column, pattern: str) -> Column:
    """A pattern with * or ? fits whole ids, whatever the case; another is an exact id or name, or an id before its bracket."""
    if "*" in pattern or "?" in pattern:
        regex = "(?is)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"
        return decl_id.rlike(regex)
    return (decl_id == pattern) | (name == pattern) | decl_id.startswith(pattern + "(")


def project(df: DataFrame, fields: list[str] | None) -> DataFrame:
    """Only the fields that were asked for, in their order; an unknown one is an error, none means all."""
    unknown = sorted(set(fields or []) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    return df.select(*fields) if fields else df
