"""Tables of the index: fixed schemas, and the ordered enumerations with their ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 6

# Fixed values of the data model: kinds, access levels from the most open, confidences from the least.
KINDS = ("struct", "class", "enum", "protocol", "actor", "extension", "func", "init", "deinit", "subscript", "var", "let", "case", "typealias", "associatedtype", "operator", "precedencegroup")
ACCESS = ("open", "public", "package", "internal", "fileprivate", "private")
CONFIDENCE = ("low", "medium", "high")
TYPE_KINDS = ("struct", "class", "enum", "protocol", "actor", "extension")
KIND_GROUPS = {
    "types": ("struct", "class", "enum", "protocol", "actor", "extension", "typealias", "associatedtype"),
    "funcs": ("func", "init", "deinit", "subscript", "operator"),
    "vars": ("var", "let"),
    "cases": ("case",),
}
CALLABLE = ("func", "init", "subscript")

TABLES = {
    "files": "id long, path string, mtime double, sha256 string, bytes long, last_indexed double",
    "declarations": "id long, decl_id string, file_id long, ordinal int, container string, container_kind string, kind string, name string, signature string, access string, spi array<string>, modifiers array<string>, start_line int, end_line int, decl_offset long, decl_length long, body_offset long, body_length long",
    "imports": "file_id long, module string, path string, kind string, spi array<string>, testable boolean, line int",
    "doc_comments": "decl_id long, text string",
    "directives": "decl_id long, tag string, value string, line int",
    "call_sites": "id long, file_id long, from_decl long, name string, receiver string, kind string, line int",
    "bindings": "file_id long, from_decl long, name string, type string, line int",
    "conformances": "file_id long, type_name string, protocol_name string",
    "narrative": "file_id long, kind string, path string, text string",
}
#: Tables that hold nothing while call sites are off.
SITE_TABLES = ("call_sites", "bindings", "conformances")


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in re.split(r", (?=\w+ )", TABLES[table])]


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position in an ordered enumeration, from 0; null for anything else."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), value) - 1
    return F.when(at >= 0, at.cast("int"))


def normal_access(access: Column) -> Column:
    """Null and empty access count as internal."""
    return F.coalesce(F.nullif(access, F.lit("")), F.lit("internal"))
