"""Declarations, imports, call sites, bindings and conformances of one Swift file.

A recursive descent over declarations; bodies are opaque to it (nothing local is a declaration) and are read for names
that are used. It is tolerant: what it does not know it steps over. Macros are not expanded. Of string literals
only the expressions inside interpolations are read, for the names that they use.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from .lexer import Comment, Token, interpolations, tokenize

# Fixed values of the language.
_ACCESS = {"open", "public", "package", "internal", "fileprivate", "private"}
_MODIFIERS = _ACCESS | {"static", "class", "final", "lazy", "weak", "unowned", "override", "required", "convenience", "mutating", "nonmutating", "indirect", "dynamic", "optional", "prefix", "postfix", "infix", "nonisolated", "isolated", "distributed", "consuming", "borrowing", "async", "rethrows", "throws"}
_TYPES = {"struct", "class", "enum", "protocol", "actor", "extension"}
_DECLARES = _TYPES | {"func", "init", "deinit", "subscript", "var", "let", "case", "typealias", "associatedtype", "operator", "precedencegroup", "import", "macro"}
_KEYWORDS = _DECLARES | {"if", "else", "guard", "while", "for", "in", "repeat", "switch", "default", "where", "return", "throw", "throws", "rethrows", "async", "await", "try", "do", "catch", "defer", "break", "continue", "fallthrough", "as", "is", "inout", "some", "any", "self", "Self", "super", "nil", "true", "false", "_", "get", "set", "willSet", "didSet", "Type", "Protocol", "init", "consume", "copy", "each", "repeat"}
_HEADS = {"if", "guard", "while", "for", "switch", "catch", "where"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def _strip_doc(comment: Comment) -> str:
    if comment.kind == "doc":
        return comment.text[3:].removeprefix(" ").rstrip("\r")
    lines = comment.text[3:-2].split("\n")
    return "\n".join(re.sub(r"^\s*\*? ?", "", x) if k else x.strip() for k, x in enumerate(lines)).strip("\n ")


class Extraction:
    """rows: declarations, imports, sites, bindings, each a list of dicts in source order."""

    def __init__(self, data: bytes, declares: bool = True):
        self.data = data
        self.tokens, self.comments = tokenize(data)
        self.match = self._pairs()
        self.starts = [c.start for c in self.comments]
        self.declarations: list[dict] = []
        self.imports: list[dict] = []
        self.sites: list[dict] = []
        self.bindings: list[dict] = []
        self.skip: set[int] = set()  # tokens that are no expression
        self.properties: set[int] = set()
        if declares:
            self._members(0, len(self.tokens), [], None, [])
        self._uses()
        self._interpolated()

    def _pairs(self) -> list[int]:
        """For an opening bracket the place of its end, or the last place."""
        match, stack = [-1] * len(self.tokens), []
        for i, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text in _OPEN:
                stack.append(i)
            elif t.kind == "sign" and t.text in _CLOSE:
                while stack and _OPEN[self.tokens[stack[-1]].text] != t.text:
                    match[stack.pop()] = i
                if stack:
                    match[stack.pop()] = i
        for i in stack:
            match[i] = len(self.tokens) - 1
        return match

    def _text(self, i: int, j: int) -> str:
        """Source of tokens i to j - 1."""
        j = min(j, len(self.tokens))
        return self.data[self.tokens[i].start : self.tokens[j - 1].end].decode("utf-8", "replace") if j > i else ""

    def _after(self, i: int) -> int:
        return self.match[i] + 1 if self.match[i] > i else i + 1

    def _is(self, i: int, *texts: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "string"

    # --- declarations

    def _members(self, i: int, end: int, stack: list[str], kind: str | None, spi: list[str]) -> None:
        tokens = self.tokens
        while i < end:
            first, groups, modifiers, attributes = i, [], [], []
            while i < end:
                t = tokens[i]
                if t.text == "@" and i + 1 < end:
                    attributes.append(tokens[i + 1].text)
                    j = i + 2
                    while self._is(j, "."):
                        j += 2
                    if self._is(j, "(") and not tokens[j].first:
                        if tokens[i + 1].text == "_spi":
                            groups += [x.text for x in tokens[j + 1 : self.match[j]] if x.kind == "word"]
                        j = self._after(j)
                    self.skip.update(range(i, j))
                    i = j
                elif t.kind == "word" and t.text in _MODIFIERS and not (t.text == "class" and i + 1 < end and tokens[i + 1].text not in _MODIFIERS | _DECLARES):
                    if t.text == "actor":
                        break
                    modifiers.append(t.text)
                    i += 1
                    if self._is(i, "("):
                        i = self._after(i)
                else:
                    break
            if i >= end:
                return
            t = tokens[i]
            if t.kind == "word" and t.text in _DECLARES and not self._is(i - 1, "."):
                i = max(i + 1, self._declaration(first, i, end, stack, kind, spi, groups, modifiers, attributes))
            elif t.kind == "hash":
                line = t.line
                while i < end and tokens[i].line == line:
                    i += 1
            else:
                i = self._after(i) if t.text in _OPEN and t.kind == "sign" else i + 1

    def _declaration(self, first: int, i: int, end: int, stack: list[str], kind: str | None, spi: list[str], groups: list[str], modifiers: list[str], attributes: list[str]) -> int:
        tokens, word = self.tokens, self.tokens[i].text
        head = dict(first=first, stack=stack, container_kind=kind, spi=[*spi, *(g for g in groups if g not in spi)], modifiers=modifiers)
        if word == "import":
            j, scoped = i + 1, None
            if self._is(j, "struct", "class", "enum", "protocol", "typealias", "func", "var", "let"):
                scoped, j = tokens[j].text, j + 1
            path = [tokens[j].text] if j < end else []
            j += 1
            while self._is(j, ".") and j + 1 < end:
                path.append(tokens[j + 1].text)
                j += 2
            if path:
                self.imports.append(dict(module=path[0], path=".".join(path), kind=scoped, spi=groups, testable="testable" in attributes, line=tokens[i].line))
            return j
        if word in _TYPES:
            j = i + 1
            if word == "extension":
                name_end = j + 1
                while self._is(name_end, ".") or (name_end < end and self._is(name_end - 1, ".")):
                    name_end += 1
                name = self._text(j, name_end)
            else:
                name, name_end = (tokens[j].text if j < end else ""), j + 1
            body = name_end
            while body < end and not self._is(body, "{"):
                body = self._after(body) if tokens[body].text in ("(", "[") else body + 1
            close = self._after(body) if body < end else end
            if not name:
                return i + 1
            self._emit(word, name, self._text(first, body), name, head, close, body=(body, close) if body < end else None, inherits=self._inherits(name_end, body))
            if body < end:
                self._members(body + 1, self.match[body], [*stack, name], word, head["spi"])
            return close
        if word in ("func", "init", "subscript", "deinit"):
            return self._callable(word, i, end, head, kind)
        if word in ("var", "let"):
            return self._variables(word, i, end, head)
        if word == "case":
            return self._cases(i, end, head)
        if word == "precedencegroup":
            j = i + 2
            close = self._after(j) if self._is(j, "{") else j
            self.skip.update(range(i, close))
            name = tokens[i + 1].text if i + 1 < end else ""
            self._emit(word, name, f"precedencegroup {name}", name, head, close, body=(j, close) if close > j else None)
            return close
        if word in ("typealias", "associatedtype", "operator", "macro"):
            j = self._line_end(i, end)
            if word == "macro" or i + 1 >= end:
                return j
            name = tokens[i + 1].text
            self.skip.update(range(i, j))
            if word == "operator":
                name = "".join(x.text for x in tokens[i + 1 : j]).split(":")[0]
            self._emit(word, name, self._text(first, j), name, head, j)
            return j
        return i + 1

    def _line_end(self, i: int, end: int) -> int:
        j = i + 1
        while j < end and not self._is(j, ";", "}") and not (self.tokens[j].first and not self._is(j - 1, "=", ":", ",", "&", "where", "==") and not self._is(j, "&", "where", "=")):
            j = self._after(j) if self.tokens[j].text in _OPEN else j + 1
        return j

    def _inherits(self, i: int, end: int) -> list[str]:
        depth = 0
        while i < end and (depth or not self._is(i, ":", "where")):
            depth += self._is(i, "<") - self._is(i, ">")
            i += 1
        if not self._is(i, ":") or i >= end:
            return []
        names, begin, depth, i = [], i + 1, 0, i + 1
        while i <= end:
            done = i == end or self._is(i, "where")
            if done or (self._is(i, ",") and not depth):
                if i > begin:
                    text = self._text(begin, i)
                    names.append(re.sub(r"^@\w+\s+", "", re.split(r"<", text)[0]).strip())
                begin = i + 1
                if done:
                    break
            depth += self._is(i, "<") - self._is(i, ">")
            i += 1
        return [n for n in names if n]

    def _callable(self, word: str, i: int, end: int, head: dict, kind: str | None) -> int:
        tokens, j = self.tokens, i + 1
        if word == "func":
            while j < end and not self._is(j, "(", "<") or (j == i + 1 and self._is(j, "<")):
                j += 1
            name = self._text(i + 1, j) or (tokens[i + 1].text if i + 1 < end else "")
        else:
            name = word
            if self._is(j, "?", "!"):
                j += 1
        if self._is(j, "<"):
            depth = 0
            while j < end:
                depth += self._is(j, "<") - self._is(j, ">")
                j += 1
                if not depth:
                    break
        parameters = ""
        if word != "deinit" and self._is(j, "("):
            parameters = self._parameters(j + 1, self.match[j])
            j = self._after(j)
        arrow = False
        effects = []
        while j < end and not self._is(j, "{", "}", ";") and not (tokens[j].first and not arrow and not self._is(j, "->", "async", "throws", "rethrows", "where") and not self._is(j - 1, "where", ",", "->")):
            effects += [tokens[j].text] if self._is(j, "async", "throws") and not arrow else []
            arrow = self._is(j, "->")
            j = self._after(j) if tokens[j].text in ("(", "[") else j + 1
        body = (j, self._after(j)) if self._is(j, "{") else None
        close = body[1] if body else j
        keep_block = word == "subscript" and kind == "protocol"
        signature = self._text(head["first"], close if keep_block else j)
        decl = name if word == "deinit" else f"{name}({parameters})"
        self._emit(word, name, signature, decl, {**head, "modifiers": head["modifiers"] + effects}, close, body=body)
        return close

    def _parameters(self, i: int, end: int) -> str:
        out = []
        for a, b in self._split(i, end):
            colon = next((k for k in range(a, b) if self._is(k, ":")), None)
            if colon is None:
                continue
            names = [t.text for t in self.tokens[a:colon] if t.kind == "word"]
            names = [n for n in names if not n.startswith("@")][-2:]
            equals = next((k for k in range(colon, b) if self._is(k, "=")), b)
            kind = self._text(colon + 1, equals)
            out.append(f"{names[0] if names else '_'}:{re.sub(' ', '', kind)}")
            if names:
                self._bind(names[-1], kind, self.tokens[a])
        return ",".join(out)

    def _split(self, i: int, end: int) -> list[tuple[int, int]]:
        parts, begin, depth = [], i, 0
        while i < end:
            if self.tokens[i].text in _OPEN and self.tokens[i].kind == "sign":
                i = self._after(i)
                continue
            depth += self._is(i, "<") - self._is(i, ">")
            if self._is(i, ",") and depth <= 0:
                parts.append((begin, i))
                begin = i + 1
            i += 1
        return [*parts, (begin, end)] if end > begin else parts

    def _variables(self, word: str, i: int, end: int, head: dict) -> int:
        tokens, j = self.tokens, i + 1
        names, body, begin, value = [], None, True, False
        while j < end:
            t = tokens[j]
            if self._is(j, "}", ";"):
                break
            if t.first and j > i + 1 and not begin and not self._is(j - 1, "=", ":", "->", "??", "&&", "||", "+", "-", "*", "/", "?", ".", "&") and not self._is(j, ".", "?", ":", "=", "{", "??", "&&", "||", "+", "-", "*", "as", "is"):
                break
            if begin and t.kind == "word":
                names.append(t.text)
                self.skip.add(j)
                self.properties.add(j)
                begin = False
            elif begin and self._is(j, "("):
                names.append(self._text(j, self._after(j)))
                j, begin = self._after(j), False
                continue
            elif self._is(j, ","):
                begin, value = True, False
            elif self._is(j, "="):
                value = True
            elif self._is(j, "{"):
                inside = tokens[j + 1].text if j + 1 < end else ""
                if not value or inside in ("willSet", "didSet"):
                    body = (j, self._after(j))
                    j = body[1]
                    break
                j = self._after(j)
                continue
            if t.text in ("(", "["):
                j = self._after(j)
                continue
            j += 1
        for name in names:
            self._emit(word, name, self._text(head["first"], j), name, head, j, body=body)
        return j

    def _cases(self, i: int, end: int, head: dict) -> int:
        j, depth_end = i + 1, i + 1
        while depth_end < end and not self._is(depth_end, "}", ";") and not (self.tokens[depth_end].first and not self._is(depth_end - 1, ",", "=")):
            depth_end = self._after(depth_end) if self.tokens[depth_end].text in _OPEN else depth_end + 1
        self.skip.update(range(i, depth_end))
        for a, b in self._split(j, depth_end):
            name = self.tokens[a].text
            self._emit("case", name, f"case {self._text(a, b)}", name, head, depth_end)
        return depth_end

    def _emit(self, kind: str, name: str, signature: str, decl: str, head: dict, end: int, body: tuple[int, int] | None = None, inherits: list[str] | None = None) -> None:
        first, last = self.tokens[head["first"]], self.tokens[min(end, len(self.tokens)) - 1]
        before = self.tokens[head["first"] - 1].end if head["first"] else 0
        at = bisect_left(self.starts, before)
        doc, directives, open_, start = [], [], True, first
        for c in self.comments[at : bisect_left(self.starts, first.start)]:
            if c.trailing:
                continue
            if c.kind in ("doc", "block-doc"):
                if open_:
                    doc.append(_strip_doc(c))
                continue
            open_ = open_ and not doc
            if c.kind == "directive" and (m := re.match(r"//#\s*ai:(\w+)\s*(?::\s*(.*?))?\s*$", c.text, re.S)):
                directives.append(dict(tag=f"ai:{m[1]}", value=m[2] or "", line=c.line))
            else:
                start = c
        path = ".".join([*head["stack"], decl])
        self.declarations.append(dict(
            decl_id=path, container=head["stack"][-1] if head["stack"] else None, container_kind=head["container_kind"], kind=kind, name=name, signature=signature.strip(),
            access=next((m for m in head["modifiers"] if m in _ACCESS), None), spi=head["spi"], modifiers=head["modifiers"], start_line=start.line, end_line=last.line + last.text.count("\n"),
            decl_offset=start.start, decl_length=last.end - start.start, body_offset=self.tokens[body[0]].start if body else None,
            body_length=self.tokens[body[1] - 1].end - self.tokens[body[0]].start if body else None, doc="\n".join(doc) or None, directives=directives, inherits=inherits or [],
        ))

    # --- uses

    def _bind(self, name: str, kind: str, at: Token) -> None:
        if (peeled := nominal(kind)) and name != "_":
            self.bindings.append(dict(name=name, type=peeled, line=at.line, offset=at.start))

    def _receiver(self, dot: int) -> str | None:
        """Source of what stands before a dot: a chain of words, calls, subscripts and marks."""
        i = dot - 1
        opens = self.opens
        while i >= 0:
            t = self.tokens[i]
            if t.kind == "sign" and t.text in _CLOSE and i in opens:
                i = opens[i]
                if i > 0 and (self.tokens[i - 1].kind in ("word", "string") and self.tokens[i - 1].text not in _KEYWORDS - {"self", "Self", "super", "init"} or self._is(i - 1, ")", "]", "?", "!")) and not self.tokens[i].first:
                    i -= 1
                    continue
            elif self._is(i, "?", "!"):
                i -= 1
                continue
            elif t.kind not in ("word", "string", "number"):
                return None if i == dot - 1 else self._text(i + 1, dot)
            if i > 0 and self._is(i - 1, "."):
                i -= 2
                continue
            return self._text(i, dot)
        return self._text(0, dot)

    def _uses(self) -> None:
        """Names in expressions: calls (before a bracket or a closure behind them) and references."""
        tokens, skip = self.tokens, self.skip
        self.opens = {v: k for k, v in enumerate(self.match) if v > k}
        for i, t in enumerate(tokens):
            if t.text in ("func", "struct", "class", "enum", "protocol", "actor", "extension", "typealias", "associatedtype", "import", "operator", "precedencegroup", "case", "macro") and t.kind == "word" and not self._is(i - 1, ".") and i + 1 < len(tokens):
                skip.add(i + 1)
                if t.text in ("extension", "import", "struct", "class", "enum", "protocol", "actor", "typealias", "associatedtype"):
                    j = i + 1
                    while j < len(tokens) and not self._is(j, "{") and not (tokens[j].first and j > i + 1 and not self._is(j - 1, ",", ":")):
                        skip.add(j)
                        j += 1
            if t.text in ("var", "let") and t.kind == "word" and i + 1 < len(tokens):
                skip.add(i + 1)
                j = i + 2
                if self._is(j, ":"):
                    a = j + 1
                    b = self._skip_type(a, skip)
                    if i + 1 not in self.properties:
                        self._bind(tokens[i + 1].text, self._text(a, b), tokens[i + 1])
                elif self._is(j, "=") and i + 1 not in self.properties and (made := self._constructed(j + 1)):
                    self.bindings.append(dict(name=tokens[i + 1].text, type=made, line=tokens[i + 1].line, offset=tokens[i + 1].start))
            if t.text in ("->", "as", "is") or (t.text == "@" and t.kind == "sign"):
                j = i + 1 + (self._is(i + 1, "?", "!"))
                self._skip_type(j, skip)
            if t.text in ("func", "init", "subscript") and t.kind == "word" and not self._is(i - 1, "."):
                j = i + 1
                while j < len(tokens) and not self._is(j, "(", "{", "}"):
                    skip.add(j)
                    j += 1
                if self._is(j, "("):
                    for a, b in self._split(j + 1, self.match[j]):
                        colon = next((k for k in range(a, b) if self._is(k, ":")), b)
                        equals = next((k for k in range(colon, b) if self._is(k, "=")), b)
                        skip.update(range(a, equals))
        for i, t in enumerate(tokens):
            if t.kind != "word" or i in skip or t.text in _KEYWORDS or (t.text in _MODIFIERS and not self._is(i - 1, ".") and self._is(i + 1, *_DECLARES, *_MODIFIERS, "(")) or t.text.startswith("$") or self._is(i - 1, "@"):
                continue
            if self._is(i + 1, ":") and (self._is(i - 1, "(", ",")):
                continue  # an argument's label
            member = self._is(i - 1, ".")
            call = self._is(i + 1, "(") and not tokens[i + 1].first
            if self._is(i + 1, "{") and not tokens[i + 1].first and not self._in_head(i):
                call = True
            receiver = self._receiver(i - 1) if member else None
            self.sites.append(dict(name=t.text.strip("`"), receiver=receiver or None, kind="call" if call else "ref", line=t.line, offset=t.start))

    def _interpolated(self) -> None:
        """Uses in the expressions inside string literals; declarations there are none of the file's."""
        for t in self.tokens:
            for start, end in interpolations(self.data, t.start) if t.kind == "string" else ():
                inner = Extraction(self.data[start:end], declares=False)
                line = t.line + self.data.count(b"\n", t.start, start) - 1
                for mine, rows in ((self.sites, inner.sites), (self.bindings, inner.bindings)):
                    mine += [{**r, "line": r["line"] + line, "offset": r["offset"] + start} for r in rows]
        self.sites.sort(key=lambda r: r["offset"])
        self.bindings.sort(key=lambda r: r["offset"])

    def _in_head(self, i: int) -> bool:
        """Whether a brace behind token i opens the block of an if, a loop or another statement of that kind."""
        line = self.tokens[i].line
        while i >= 0 and not self._is(i, "{", "}", ";") and line - self.tokens[i].line <= 3:
            if self.tokens[i].text in _HEADS or self.tokens[i].text in ("var", "let", "->", "else", "do", "in"):
                return True
            i -= 1
        return False

    def _skip_type(self, i: int, skip: set[int]) -> int:
        depth = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.text in ("(", "[") and not (t.text == "(" and self.tokens[i - 1].kind == "word" and not t.first and self.tokens[i - 1].text not in ("any", "some")):
                skip.update(range(i, self._after(i)))
                i = self._after(i)
            elif t.kind == "word" and (t.text in ("any", "some", "inout", "Self", "async", "throws") or t.text not in _KEYWORDS) and not (t.first and not self._is(i - 1, "->", ":", "&", ".", "<", ",")):
                if i and self.tokens[i - 1].kind == "word" and self.tokens[i - 1].text not in ("any", "some", "inout", "async", "throws", "as", "is") and not depth:
                    return i
                skip.add(i)
                i += 1
            elif t.text in (".", "?", "!", "&", "->") or (t.text == "<") or (depth and t.text in (">", ",", ":")):
                depth += (t.text == "<") - (t.text == ">")
                i += 1
            else:
                return i
        return i

    def _constructed(self, i: int) -> str | None:
        """Type that an initialiser makes: Foo(...), A.B(...), Foo.init(...)."""
        while self._is(i, "try", "await", "?", "!"):
            i += 1
        names = []
        while i < len(self.tokens) and self.tokens[i].kind == "word":
            names.append(self.tokens[i].text)
            if not self._is(i + 1, "."):
                break
            i += 2
        if names and names[-1] == "init":
            names.pop()
        if self._is(i + 1, "(") and names and names[-1][:1].isupper():
            return names[-1]
        return None


def nominal(text: str) -> str | None:
    """The named type of a written one: marks, any, some, attributes and single brackets peeled; arrays, dictionaries,
    functions and tuples by fixed names; none for Self."""
    text = text.strip()
    while True:
        new = re.sub(r"^(?:@\w+(?:\([^)]*\))?|inout|any|some|borrowing|consuming|__owned|isolated|sending)\s+", "", text).strip()
        new = new[:-1].strip() if new[-1:] in ("?", "!") else new
        new = new.removesuffix("...").strip()
        if "->" in new and not (new.startswith("(") and new.endswith(")") and _encloses(new)):
            return "(function)"
        if new.startswith("(") and new.endswith(")") and _encloses(new):
            inner = new[1:-1].strip()
            if not inner or _top_level(inner, ","):
                return "(tuple)"
            new = inner
        if new.startswith("[") and new.endswith("]"):
            return "Dictionary" if _top_level(new[1:-1], ":") else "Array"
        if new == text:
            break
        text = new
    name = re.split(r"[<&\s]", text)[0].split(".")[-1]
    return name if name and name != "Self" and re.match(r"[\w`]", name) else None


def _encloses(text: str) -> bool:
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth:
            return k == len(text) - 1
    return False


def _top_level(text: str, sign: str) -> bool:
    depth = 0
    for c in text:
        depth += (c in "([<") - (c in ")]>")
        if c == sign and not depth:
            return True
    return False


def owner_of(declarations: list[dict], offset: int) -> int | None:
    """Number of the shortest declaration around a byte offset; of equal ones the first."""
    best = None
    for k, d in enumerate(declarations):
        if d["decl_offset"] <= offset < d["decl_offset"] + d["decl_length"] and (best is None or d["decl_length"] < declarations[best]["decl_length"]):
            best = k
    return best
