"""Main text of web pages by composite text density.

Every block element is a node with its characters C, tags T, link characters LC and link tags LT. Its density is

    C / T * log(C / LC * T / LT, base: ln(C / (C - LC) * LC + LCb / Cb * C + e))

(b: the body; zeros count as one), so links lower it. The subtree whose children have the largest sum of densities is the
text. The least density on its path to the body is the threshold from which subtrees beside that path count as text too, whole;
so do headings and paragraphs that stand directly before or after what is kept, if links are no large part of them. Elements
named article or main take precedence where they agree with that: they hold the subtree, or most of its text.

Elements that are noise by what they are (navigation, forms, footers) are left out. A name (class or id) is evidence only: an
element named like noise is kept if it holds an article, or most of the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup: it ends at their own end tag.
_RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg".split())
#: Of these a slash at the end of the tag closes them at once, unless it belongs to an unquoted value.
_FOREIGN = frozenset(("svg",))
_UNQUOTED_SLASH = re.compile(r"""=\s*[^\s"']*/$""")
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr ul".split())
_ENDS_P = _BLOCK - {"thead", "tbody", "tfoot", "tr", "caption", "legend", "html", "body"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Tags that bar a search for an open paragraph.
_GROUPS = {tag: ("#block",) for tag in _BLOCK}

_NOISE_TAGS = frozenset("head nav footer aside form button select option input dialog menu object embed canvas audio video applet datalist".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())


def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


#: Names of noise that hardly stand for anything else, and words that a text may be about as well.
_STRONG_NAMES = _names(r"ads?|adv|advert\w*|sponsor\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footer|comments?|commentlist|disqus|cookies?|consent|gdpr|popups?|newsletter|subscri\w+|signup|login|pagination|pager|copyright")
_WEAK_NAMES = _names(r"promo\w*|banners?|aside|repl(?:y|ies)|respond|notices?|notifications?|alerts?|modal|overlay|share|sharing|social|related|recommend\w*|widgets?|toolbar|disclaimer")
#: Elements of running text: only a strong name makes these noise. And those of them, and others, that may stand beside a text.
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th b i em strong u code q mark small sub sup time abbr cite dfn kbd var".split())
_BESIDE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
_MOST_LINKS = 1 / 3
_TOP_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)


class _Node:
    __slots__ = ("children", "chars", "density", "dropped", "end", "first", "holds", "link_chars", "link_tags", "named", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: int, named: int, first: int):
        self.tag, self.parent, self.named, self.first, self.end = tag, parent, named, first, first
        self.children: list[int] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.dropped, self.holds = False, frozenset()

    @property
    def prose(self) -> int:
        return self.chars - self.link_chars


def _is_noise(tag: str, inside_text: bool, told: dict[str, str]) -> bool:
    """Whether an element is noise by what it is."""
    if tag in _NOISE_TAGS or (tag == "header" and not inside_text):
        return True
    if "hidden" in told or told.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", told.get("style", ""), re.I):
        return True
    return told.get("role", "").lower() in _NOISE_ROLES


def _named(tag: str, inside_text: bool, told: dict[str, str]) -> int:
    """2: named like noise, 1: by a word that may mean something else, 0: not."""
    names = f"{told.get('class', '')} {told.get('id', '')}"
    if tag in ("article", "main", "body", "html") or not names.strip():
        return 0
    if _STRONG_NAMES.search(names) or (not inside_text and tag not in _TEXT_TAGS and _TOP_NAMES.search(names)):
        return 2
    return int(tag not in _TEXT_TAGS and bool(_WEAK_NAMES.search(names)))


def _told(attributes: str) -> dict[str, str]:
    told: dict[str, str] = {}
    if attributes.strip(" /"):
        for name, value in _ATTRIBUTE.findall(attributes):
            told.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return told


class _Open:
    """The elements that are open, with the places of each tag, so that none is looked for by a walk."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, its node, noise, whether the node is its own
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, node: int, noise: bool, own: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        for group in _GROUPS.get(tag, ()):
            self.places.setdefault(group, []).append(len(self.stack))
        self.stack.append((tag, node, noise, own))

    def pop(self) -> tuple[str, int, bool, bool]:
        top = self.stack.pop()
        self.places[top[0]].pop()
        for group in _GROUPS.get(top[0], ()):
            self.places[group].pop()
        return top

    def last(self, *names: str) -> int:
        """Where the innermost of these tags or groups is open; 0 if none is (that is the body)."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)


class _Page:
    """Nodes in page order (node 0 is the body), one for each block and each element with a name like noise, and pieces of
    text: (text, number of its block, is a link's)."""

    def __init__(self, source: str):
        self.nodes = [_Node("body", -1, 0, 0)]
        self.pieces: list[tuple[str, int, bool]] = []
        self.block = 0
        self._read(source)
        self._judge()

    def _read(self, source: str) -> None:
        open_, links, at, nodes, inside_text = _Open(), 0, 0, self.nodes, 0
        open_.push("body", 0, False, True)
        stack = open_.stack

        def text(piece: str) -> None:
            if piece and not stack[-1][2]:
                piece = html.unescape(piece)
                self.pieces.append((piece, self.block, links > 0))
                node, n = nodes[stack[-1][1]], len("".join(piece.split()))
                node.chars += n
                if links:
                    node.link_chars += n

        def pop_to(depth: int) -> None:
            nonlocal links, inside_text
            while len(stack) > depth:
                tag, node, _, own = open_.pop()
                if tag == "a":
                    links -= 1
                if tag in ("article", "main"):
                    inside_text -= 1
                if own:
                    nodes[node].end = len(self.pieces)
                if tag in _BLOCK:
                    self.block += 1

        while m := _TOKEN.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                depth = open_.last(tag)
                if depth and (tag in _BLOCK or depth >= open_.last("table", "article", "main")):
                    pop_to(depth)
                continue
            attributes = m[3] or m[6] or ""
            if tag in _FOREIGN and attributes.endswith("/") and not _UNQUOTED_SLASH.search(attributes):
                continue
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*[/>]", re.I).search(source, at)
                at = source.find(">", close.start()) + 1 if close else len(source)
                at = at or len(source)
                continue
            if tag in ("html", "body"):
                continue
            if tag == "head":
                open_.push(tag, stack[-1][1], True, False)
                continue
            if stack[-1][0] == "head" and tag not in _VOID:
                pop_to(len(stack) - 1)
            if tag in _ENDS_P and (depth := open_.last("p")) and depth >= open_.last("#block", "td", "th", "button", "object"):
                pop_to(depth)
            if tag in _IMPLIED:
                ends, stops = _IMPLIED[tag]
                depth = open_.last(*ends)
                if depth and depth >= open_.last(*stops):
                    pop_to(depth)
            parent, noise = stack[-1][1], stack[-1][2]
            if tag in ("br", "td", "th", "wbr") and not noise:
                self.pieces.append((" " if tag != "wbr" else "", self.block, False))
            nodes[parent].tags += not noise
            if tag in _VOID:
                self.block += tag == "hr"
                continue
            told = _told(attributes)
            noise = noise or _is_noise(tag, inside_text > 0, told)
            named = 0 if noise else _named(tag, inside_text > 0, told)
            if tag == "a":
                links += 1
                nodes[parent].link_tags += not noise
            if tag in ("article", "main"):
                inside_text += 1
            self.block += tag in _BLOCK
            own = not noise and (tag in _BLOCK or named > 0)
            node = parent
            if own:
                node = len(nodes)
                nodes.append(_Node(tag, parent, named, len(self.pieces)))
                nodes[parent].children.append(node)
            open_.push(tag, node, noise, own)
        text(source[at:])
        pop_to(0)
        nodes[0].first, nodes[0].end = 0, len(self.pieces)

    def _judge(self) -> None:
        """Drop elements that are named like noise, unless they hold an article or most of the text."""
        nodes = self.nodes
        prose, holds = [n.prose for n in nodes], [{n.tag} & {"article", "main", "h1"} for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
            prose[nodes[k].parent] += prose[k]
            holds[nodes[k].parent] |= holds[k]
        for k, n in enumerate(nodes):
            up = n.parent >= 0 and nodes[n.parent].dropped
            most = 2 * prose[k] > prose[0] and (n.named == 1 or "h1" in holds[k])
            n.dropped = up or (n.named > 0 and not most and not holds[k] & {"article", "main"})

    def _densities(self) -> None:
        for node in reversed(self.nodes):
            if node.parent >= 0 and not node.dropped:
                up = self.nodes[node.parent]
                up.chars += node.chars
                up.tags += node.tags
                up.link_chars += node.link_chars
                up.link_tags += node.link_tags
        body = self.nodes[0]
        share = body.link_chars / (body.chars or 1)
        for node in reversed(self.nodes):
            c, t = node.chars, node.tags or 1
            if c and not node.dropped:
                lc, lt, rest = node.link_chars or 1, node.link_tags or 1, (c - node.link_chars) or 1
                base = math.log(c / rest * node.link_chars + share * c + math.e)
                node.density = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / max(math.log(base), 0.1) if base > 1 else c / t)
                if node.parent >= 0:
                    self.nodes[node.parent].sum += node.density

    def best(self) -> int:
        """The node whose children have the largest sum of densities: the first of equals, the body if no node has children."""
        return max((k for k, n in enumerate(self.nodes) if not n.dropped), key=lambda k: (self.nodes[k].sum, -k))

    def text(self) -> str:
        self._densities()
        nodes, best = self.nodes, self.best()
        ends = list(range(1, len(nodes) + 1))  # one past the last node of a subtree
        for k in range(len(nodes) - 1, 0, -1):
            ends[nodes[k].parent] = max(ends[nodes[k].parent], ends[k])
        articles, upto = [], 0
        for k, n in enumerate(nodes):
            if k >= upto and n.tag in ("article", "main") and n.chars and not n.dropped:
                articles.append(k)
                upto = ends[k]  # what is nested belongs to the outer one
        if articles and (any(k <= best < ends[k] for k in articles) or 2 * sum(nodes[k].prose for k in articles) >= nodes[best].prose):
            return self._join([(nodes[k].first, nodes[k].end) for k in articles])
        least, path, k = nodes[best].density, [best], best
        while k:
            k = nodes[k].parent
            path.append(k)
            least = min(least, nodes[k].density)
        ranges = [(nodes[best].first, nodes[best].end)]
        for below, above in zip(path, path[1:], strict=False):
            ranges += self._beside(nodes[above].children, below, least)
        return self._join(sorted(ranges))

    def _beside(self, children: list[int], inner: int, least: float) -> list[tuple[int, int]]:
        """Ranges of the children beside the inner one that belong to the text."""
        nodes = self.nodes
        kept = [c == inner or (nodes[c].density >= least and nodes[c].chars > 0 and not nodes[c].dropped) for c in children]
        near = [not n.dropped and n.chars > 0 and n.tag in _BESIDE and n.link_chars < _MOST_LINKS * n.chars for n in (nodes[c] for c in children)]
        for order in (range(1, len(children)), range(len(children) - 2, -1, -1)):
            step = order.step
            for k in order:
                kept[k] = kept[k] or (near[k] and kept[k - step])
        return [(nodes[c].first, nodes[c].end) for c, ok in zip(children, kept, strict=True) if ok and c != inner]

    def _join(self, ranges: list[tuple[int, int]]) -> str:
        gone = bytearray(len(self.pieces))
        for n in self.nodes:
            if n.dropped and not self.nodes[n.parent].dropped:
                gone[n.first : n.end] = b"\1" * (n.end - n.first)
        blocks, parts, number, upto = [], [], -1, 0
        for first, end in ranges:
            for at in range(max(first, upto), end):
                piece, block, _ = self.pieces[at]
                if gone[at]:
                    continue
                if block != number:
                    blocks.append("".join(parts))
                    parts, number = [], block
                parts.append(piece)
            upto = max(upto, end)
        blocks.append("".join(parts))
        return "\n".join(x for b in blocks if (x := " ".join(b.split())))


def main_text(source: str | None) -> str:
    """The main text of a page: blocks in page order, one a line; empty for null, empty or textless pages."""
    return _Page(source or "").text()




def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns `keep` of pages with text and n_chars (code points). One row for each row, also equal ones; null and
    empty pages give an empty text; other columns are not read; no shuffle."""
    common.arrow_batches(pages.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(html_col).alias("source"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s.as_py()) for s in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    done = rows.mapInArrow(run, f"{schema}, text string, n_chars long" if schema else "text string, n_chars long")
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars")
