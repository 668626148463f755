"""Whole-text encoding with the tokenizers library; each distinct chunk of text is encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than space, tab, newline and return (engines differ about it), or runs that a tokenizer takes as one
#: piece: texts that hold these are given to the library whole.
_ODD = "[\x0b\x0c\x1c-\x1f\u0085  ᠎ -​    　﻿\x01]"
_RUNS = _ODD + "|[ \t\n\r]{3}|[ \t\n\r]{2}$"
#: Bytes of text that are encoded together, and that one call of the library gets.
_SLICE, _CALL = 6 << 20, 1 << 16
#: Letters, then signs: two pieces of either kind of tokenizer. Each letter is one in lower case, too; U+0130, the only one in
#: these ranges that is not, becomes a letter and a mark, and the mark may belong to the signs behind it.
_WORD_SIGNS = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([!-&(-/:-@]+)").fullmatch


class ChunkEncoder:
    """Encodes columns of texts to one array of ids and the texts' offsets in it.

    A tokenizer that never takes a non-space and the space after it as one piece gives the same ids for each "space, then
    non-spaces" alone as for the whole text. Two such kinds are told by the tokenizer's own description: byte level with
    its own pattern and no normalizer; a split that removes white space after NFC and lower case. Other tokenizers get
    whole texts. The first max_entries distinct chunks are remembered, later ones are encoded anew, which changes speed
    only. Texts that hold the string of an added token (such as an end mark) are given to the library whole, which takes it
    as that token. Null texts are empty.
    """

    def __init__(self, path: str, max_entries: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.kind = self._kind(told)
        added = [re.escape(x["content"]) for x in told.get("added_tokens") or []]
        self.odd = "|".join([_RUNS if self.kind == "keep" else _ODD, *(f"(?i:{x})" for x in added)])
        suffix = (told.get("model") or {}).get("end_of_word_suffix") or ""
        lengths = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            lengths[i] = len(token.removesuffix(suffix) if suffix else token)  # a byte-level token has a character a byte
        self.lengths, self.max_entries = lengths, max_entries
        self.index: dict[str, int] = {}
        self.pool, self.start, self.count = np.zeros(0, self.dtype), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @staticmethod
    def _kind(told: dict) -> str:
        pre, norm = told.get("pre_tokenizer") or {}, told.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "keep"
        steps = pre.get("pretokenizers") or [{}]
        kinds = [x.get("type") for x in (norm or {}).get("normalizers") or []]
        if [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and kinds == ["NFC", "Replace", "Lowercase"]:
            return "drop"
        return "whole"

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _add(self, chunks: list[str], count: np.ndarray, ids: list[np.ndarray]) -> None:
        base = len(self.start)
        self.index.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(count) - count).astype(np.int32)])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.pool = np.concatenate([self.pool, *ids])

    def _gather(self, each: np.ndarray, count: np.ndarray) -> np.ndarray:
        ends = np.cumsum(count, dtype=np.int32)  # of some megabytes of text
        return self.pool[np.repeat(self.start[each] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]

    def _learn(self, new: list[str]) -> None:
        """Add unseen chunks: words with signs behind them from their two parts, the rest from the library."""
        parts = [(x, m[1], m[2]) for x in new if (m := _WORD_SIGNS(x))]
        whole = {x for x in new if x not in self.index} - {x for x, _, _ in parts}
        whole.update(b for _, b, _ in parts)
        whole.update(c for _, _, c in parts)
        self._encode(list(whole.difference(self.index)))
        if parts:
            each = np.array([(self.index[b], self.index[c]) for _, b, c in parts], np.int64).ravel()
            self._add([x for x, _, _ in parts], self.count[each].reshape(-1, 2).sum(1), [self._gather(each, self.count[each])])

    def _encode(self, new: list[str]) -> None:
        """Encode chunks; tokens of a joined text belong to chunks by their length in bytes."""
        if self.kind == "keep":  # what has no white space before it, or nothing else, would join its neighbours
            alone = [x for x in new if x[:1] not in (" ", "\n") or x.isspace()]
            gone = set(alone)
            joined = [x for x in new if x not in gone]
        else:
            alone, joined = [], new
        gap, ids, counts = "" if self.kind == "keep" else " ", [], []
        size = np.cumsum([len(x) for x in joined])
        at = 0
        while at < len(joined):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _CALL, "right")))
            text = gap.join(joined[at:end])
            got = self._library(text)
            parts = joined[at:end] if self.kind == "keep" else self.tok.normalizer.normalize_str(text).split(" ")
            ends = np.cumsum([len(x.encode()) for x in parts])
            upto = np.concatenate([[0], np.cumsum(self.lengths[got])])
            cut = np.searchsorted(upto, ends, "left")
            if len(parts) == end - at and upto[-1] == ends[-1] and np.array_equal(upto[cut], ends):
                ids.append(got)
                counts.append(np.diff(cut, prepend=0))
            else:
                alone += joined[at:end]
                joined[at:end] = [None] * (end - at)
            at = end
        each = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(alone, add_special_tokens=False)]
        self._add([x for x in joined if x is not None] + alone, np.concatenate([*counts, np.array([len(x) for x in each], np.int64)]), [*ids, *each])

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "keep":
            marked = pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n")
            lists = pc.split_pattern(marked, "\x01")
        else:
            for space in "\n\r\t":
                texts = pc.replace_substring(texts, space, " ")
            lists = pc.split_pattern(pc.ascii_lower(texts), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        get, kept = self.index.get, len(self.start)
        where = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
        if len(new := np.flatnonzero(where < 0)):
            self._learn([words[i] for i in new])
            where[new] = [self.index[words[i]] for i in new]
        each = where[coded.indices.to_numpy(zero_copy_only=False)]
        count = self.count[each]
        ids, ends = self._gather(each, count), np.concatenate([[0], np.cumsum(count)])
        if len(self.start) > self.max_entries:
            for x in list(self.index)[kept:]:  # in the order of their numbers
                del self.index[x]
            self.start, self.count, self.pool = self.start[:kept], self.count[:kept], self.pool[: self.start[kept - 1] + self.count[kept - 1] if kept else 0]
        cuts = np.asarray(lists.offsets, np.int64)
        return ids, ends[cuts - cuts[0]]

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Yields (row of the first text, ids, offsets of the texts in ids), some texts at a time."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "").cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            if self.kind == "whole" or odd[at]:
                ids = self._library(texts[at].as_py())
                yield at, ids, np.array([0, len(ids)])
                at += 1
                continue
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _SLICE, "right")))
            if odd[at:end].any():
                end = at + int(np.argmax(odd[at:end]))
            yield at, *self._chunked(texts.slice(at, end - at))
            at = end


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str, max_entries: int = 1_200_000) -> ChunkEncoder:
    """One encoder per worker and tokenizer file; a million chunks take about 200 MB of memory."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path, max_entries)
    return _encoders[path]
