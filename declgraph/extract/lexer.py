"""Tokens of Swift source with byte offsets. Comments are kept apart; string contents are opaque."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, sign, hash
    text: str
    start: int
    end: int
    line: int
    first: bool  # first on its line


class Comment(NamedTuple):
    kind: str  # doc, block-doc, directive, line, block
    text: str
    start: int
    end: int
    line: int
    trailing: bool  # behind a token of its line


_NEXT = re.compile(
    rb"""(?P<space>[ \t\r\f\v\0\xc2\xa0]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<string>\#*(?:\"\"\"|\"))"""
    rb"""|(?P<hash>\#[A-Za-z]\w*)|(?P<number>0[xob][0-9a-fA-F_.pP]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9]+)?)"""
    rb"""|(?P<word>`[^`\n]*`|(?:[A-Za-z_$]|[\x80-\xff])(?:\w|\$|[\x80-\xff])*)|(?P<sign>->|==|&&|\|\||\?\?|\.\.\.|\.\.<|[^\s])""",
    re.X,
)


def interpolations(data: bytes, start: int) -> list[tuple[int, int]]:
    """Byte ranges of the expressions inside the literal that begins at `start`, without their brackets."""
    opening = _NEXT.match(data, start)
    found: list[tuple[int, int]] = []
    if opening and opening.lastgroup == "string":
        _string_end(data, opening.end(), opening[0], found)
    return found


def _string_end(data: bytes, at: int, opening: bytes, found: list[tuple[int, int]] | None = None) -> int:
    """End of a literal whose opening quotes end at `at`; interpolations nest, and found gets the ranges of the outer ones."""
    pounds = opening.count(b"#")
    quote = opening.lstrip(b"#")
    close, escape = quote + b"#" * pounds, b"\\" + b"#" * pounds
    n = len(data)
    while at < n:
        if data.startswith(close, at):
            return at + len(close)
        if data.startswith(escape, at):
            at += len(escape)
            if data[at : at + 1] == b"(":
                depth, inside = 0, at + 1
                while at < n:
                    c = data[at : at + 1]
                    if c == b"(":
                        depth += 1
                    elif c == b")":
                        depth -= 1
                        if not depth:
                            if found is not None:
                                found.append((inside, at))
                            at += 1
                            break
                    elif c == b'"':
                        inner = b'"""' if data.startswith(b'"""', at) else b'"'
                        at = _string_end(data, at + len(inner), inner)
                        continue
                    at += 1
            else:
                at += 1
            continue
        if data[at : at + 1] == b"\n" and len(quote) == 1:
            return at
        at += 1
    return n


def tokenize(data: bytes) -> tuple[list[Token], list[Comment]]:
    tokens: list[Token] = []
    comments: list[Comment] = []
    at, line, fresh, n = 0, 1, True, len(data)
    while at < n:
        m = _NEXT.match(data, at)
        if not m:
            at += 1
            continue
        kind, start, end = m.lastgroup, at, m.end()
        if kind == "newline":
            line, fresh, at = line + 1, True, end
            continue
        if kind == "space":
            at = end
            continue
        if kind == "block":
            depth, end = 1, start + 2
            while end < n and depth:
                if data.startswith(b"/*", end):
                    depth, end = depth + 1, end + 2
                elif data.startswith(b"*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
        elif kind == "string":
            end = _string_end(data, end, m[0])
        text = data[start:end].decode("utf-8", "replace")
        if kind == "line":
            of = "directive" if re.match(r"//#\s*ai:", text) else "doc" if text.startswith("///") and not text.startswith("////") else "line"
            comments.append(Comment(of, text, start, end, line, not fresh))
        elif kind == "block":
            of = "block-doc" if text.startswith("/**") and not text.startswith("/***") and len(text) > 4 else "block"
            comments.append(Comment(of, text, start, end, line, not fresh))
        else:
            tokens.append(Token(kind, text, start, end, line, fresh))
            fresh = False
        line += data.count(b"\n", start, end)
        at = end
    return tokens, comments
