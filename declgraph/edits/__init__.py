"""Edits of source bytes on the driver: cut, replace, insert, move, rename; each guarded by the hash that was indexed."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path


class RefusedEdit(RuntimeError):
    """The file or the edit is not what it should be; nothing was written."""


def guarded(path: Path, expected: str | None) -> bytes:
    data = path.read_bytes()
    if expected is not None and hashlib.sha256(data).hexdigest() != expected:
        raise RefusedEdit(f"{path} changed since it was indexed")
    return data


def apply(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """Replace (start, end) ranges; the highest first, so that lower offsets hold."""
    upto = len(data)
    for start, end, new in sorted(edits, key=lambda e: e[0], reverse=True):
        if not 0 <= start <= end <= upto:
            raise RefusedEdit("edits overlap or lie outside the file")
        data, upto = data[:start] + new + data[end:], start
    return data


def indent_of(data: bytes, at: int) -> bytes:
    begin = data.rfind(b"\n", 0, at) + 1
    return re.match(rb"[ \t]*", data[begin:])[0]


def reindent(text: str, indent: str) -> str:
    """The common indent of all lines gives way to another; empty lines stay empty."""
    lines = text.split("\n")
    common = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(indent + x[common:] if x.strip() else "" for x in lines)


def with_comments(data: bytes, start: int) -> int:
    """Start of the block of comment lines that stands directly above."""
    begin = data.rfind(b"\n", 0, start) + 1
    while begin:
        above = data.rfind(b"\n", 0, begin - 1) + 1
        if not data[above : begin - 1].strip().startswith((b"//", b"*", b"/*")):
            break
        begin = above
    return begin


def cut_range(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The range with its line's indent, the rest of its last line if blank, and one empty line after it."""
    begin = data.rfind(b"\n", 0, start) + 1
    start = begin if not data[begin:start].strip() else start
    rest = re.match(rb"[ \t]*\n?", data[end:])
    end += rest.end() if rest and (rest[0].endswith(b"\n") or end + rest.end() == len(data)) else 0
    blank = re.match(rb"[ \t]*\n", data[end:])
    return start, end + (blank.end() if blank and (start == 0 or data[:start].endswith(b"\n\n")) else 0)


def clip(path: Path, start: int, length: int, payload: bytes, how: str, expected: str | None = None, with_doc: bool = False) -> bytes:
    """replace, after, before or cut a declaration; returns the new content, which is written."""
    data = guarded(path, expected)
    end = start + length
    if end > len(data):
        raise RefusedEdit("the declaration ends after the file")
    if how != "cut" and not payload.strip():
        raise RefusedEdit("nothing to paste")
    begin = with_comments(data, start) if with_doc else start
    pad = indent_of(data, start)
    new = reindent(payload.decode().strip("\n"), pad.decode()).encode()
    if how == "cut":
        edit = (*cut_range(data, begin, end), b"")
    elif how == "replace":
        edit = (begin, end, new[len(pad) :] if not with_doc else new)
    elif how == "after":
        edit = (end, end, b"\n\n" + new)
    else:
        edit = (data.rfind(b"\n", 0, begin) + 1,) * 2 + (new + b"\n\n",)
    out = apply(data, [edit])
    path.write_bytes(out)
    return out


def move(source: Path, start: int, length: int, target: Path, at: int | None = None, expected: str | None = None) -> None:
    """A declaration with the comments above it goes to another file (its end, or a place in it), or within its own."""
    data = guarded(source, expected)
    begin, end = cut_range(data, with_comments(data, start), start + length)
    if source == target and at is not None and begin <= at < end:
        raise RefusedEdit("the destination is inside what moves")
    text = data[begin:end].strip(b"\n")
    other = data if source == target else (target.read_bytes() if target.exists() else b"")
    place = len(other) if at is None else at
    new = b"\n\n" + reindent(text.decode(), indent_of(other, place).decode() if at is not None else "").encode() + b"\n"
    if source == target:
        source.write_bytes(apply(data, [(begin, end, b""), (place, place, new)]))
    else:
        target.write_bytes(apply(other, [(place, place, new)]))
        source.write_bytes(apply(data, [(begin, end, b"")]))


def name_offset(data: bytes, start: int, length: int, name: str) -> int | None:
    """Byte offset of the first whole-word occurrence of a name in a declaration."""
    found = re.search(rb"(?<![\w$])" + re.escape(name.encode()) + rb"(?![\w$])", data[start : start + length])
    return start + found.start() if found else None


def is_identifier(name: str) -> bool:
    return bool(re.fullmatch(r"[^\W\d]\w*", name))


def rename(path: Path, start: int, length: int, name: str, new: str, expected: str | None = None) -> bytes:
    """The declaration's own name changes; references are reported by the call graph, never rewritten."""
    if not is_identifier(new):
        raise RefusedEdit(f"{new!r} is no identifier")
    data = guarded(path, expected)
    at = name_offset(data, start, length, name)
    if at is None:
        raise RefusedEdit(f"{name} is not in the declaration")
    out = apply(data, [(at, at + len(name.encode()), new.encode())])
    path.write_bytes(out)
    return out


STUB = b"{ ... }"


def fold(source: bytes, parts: list[tuple[int, int, int | None, int | None, str, bool]], keep: frozenset[str] = frozenset(), deep: bool = False) -> bytes:
    """Source with what it holds folded. parts: offset, length, body's offset and length (null without one), id, whether it is
    a type. Bodies become { ... }, and the members of nested types too, unless deep; what is kept stays as it is.

    Ranges nest, so one pass in their order is enough: what lies inside a folded one is skipped."""
    out, upto = [], 0
    for start, length, body, size, decl, is_type in sorted(parts, key=lambda p: (p[0], -p[1])):
        if start < upto or decl in keep or (is_type and deep):
            continue
        if is_type:
            low, high = source.find(b"{", start, start + length), source.rfind(b"}", start, start + length)
            found = (low, high + 1) if 0 <= low < high else None
        else:
            found = (body, body + size) if body is not None and size else None
        if found and upto <= found[0] and found[1] <= len(source):
            out += [source[upto : found[0]], STUB]
            upto = found[1]
    return b"".join([*out, source[upto:]])
