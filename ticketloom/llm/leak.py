"""Evaluation passages inside a corpus.

Method: q-gram lemma filtering. Item and document are reduced to their letters and digits. Hashed character q-grams that
a document shares with an item are counted in overlapping bands of diagonals (document position minus item position).
A passage of L characters with at most k edits shares at least L + 1 - q - kq q-grams in one band, so bands with fewer are
dropped; the others are aligned within the band, and an alignment with more edits than allowed for its length is
dropped too. The reported passages are then checked exactly: `min_words` consecutive words of the item, from a word's start
to a word's end.

Case, punctuation, white space, line and quoting marks, inline markup and invisible characters count for nothing.
Null and empty texts and items, and items of fewer than `min_words` words, match nothing. Very long texts are read whole,
in one array. Repeated documents are reported each, repeated pairs once. Empty tables give an empty result. Only the named
columns are read, so extra or clashing ones do no harm.

The items are sent to every task in blocks of `BLOCK_CHARS` characters at most, whatever their number. Where there are
several blocks, one scan first keeps the documents that share so many q-grams with any items as a passage needs, by a bitmap
of fixed size of all items' q-grams, and the blocks meet only those; no document with a passage is left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import written

Q = 12
MIN_WORDS = 12
EDITS = 2
#: Characters of items in one block; its q-gram index takes about 40 times as many bytes.
BLOCK_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Slots of the bitmap of all items' q-grams, as a power of 2; 16 MB.
FILTER_BITS = 27

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
#: A tag of any length if it is made of attributes with values; else one of 300 characters, since prose may stand between < and >.
_TAG = re.compile(r"<[A-Za-z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))+\s*/?>|</?[A-Za-z][^<>]{0,300}>|<!--.*?-->", re.S)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)|\[([^\[\]|\n]+)\|(?:https?|mailto|ftp):[^\]\s]*\]|\{color(?::[^{}\n]+)?\}|\\(?:textbf|textit|emph|text|underline)\{")
_WORD = re.compile(r"[^\W_]+")


def _clean(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "[" in text or "{" in text:
        text = _LINK.sub(lambda m: m[1] or m[2] or "", text)
    return text if text.isascii() else _INVISIBLE.sub("", text)


def letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the letters and digits of a text, and the positions in them where words start and end."""
    words = _WORD.findall(_clean(text).lower())
    if not words:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint32), none, none
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    return codes, np.concatenate([[0], ends[:-1]]), ends


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide, out = codes.astype(np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            out = out * _BASE + wide[j : j + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))


def _longest_run(same: np.ndarray) -> int:
    """The longest run of true values down any column."""
    padded = np.zeros((len(same) + 2, same.shape[1]), np.int8)
    padded[1:-1] = same
    step = np.diff(padded, axis=0).T
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return int((ends - starts).max(initial=0))


class Index:
    """The q-grams of one block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, min_words: int = MIN_WORDS, edits: int = EDITS):
        self.q, self.min_words, self.edits = q, min_words, edits
        self.ids, self.codes, self.starts, self.ends, least = [], [], [], [], []
        short, hashes, where, whose = [], [], [], []
        for item_id, text in items:
            codes, starts, ends = letters(text)
            if len(starts) < min_words:
                continue
            k = len(self.ids)
            g = grams(codes, q)
            hashes.append(g)
            where.append(np.arange(len(g)))
            whose.append(np.full(len(g), k))
            self.ids.append(item_id)
            self.codes.append(codes)
            self.starts.append(starts)
            self.ends.append(ends)
            shortest = int((ends[min_words - 1 :] - starts[: len(starts) - min_words + 1]).min())
            short.append(shortest)
            least.append(max(1, shortest + 1 - q - edits * q))
        self.least, self.short = np.array(least, np.int64), np.array(short, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h = h[order]
        self.at = (np.concatenate(where) if where else np.zeros(0, np.int64))[order]
        self.item = (np.concatenate(whose) if whose else np.zeros(0, np.int64))[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, item position, document position) of every q-gram the document shares with an item."""
        g = grams(codes, self.q)
        at = np.flatnonzero(self.seen[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo = np.searchsorted(self.h, g[at], "left")
        n = np.searchsorted(self.h, g[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        k = np.repeat(lo, n) + step
        return self.item[k], self.at[k], np.repeat(at, n)

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item, item from, item to, least diagonal, greatest diagonal) of the bands that meet the lemma's bound."""
        item, a, d = self.shared(codes)
        if not len(item):
            return []
        width, diagonal = 2 * self.edits + 2, d - a
        out = {}
        for shift in (0, width // 2):  # bands overlap by half, so a passage's drift of `edits` lies in one of them
            band = (diagonal + shift) // width
            order = np.lexsort((a, band, item))
            i, b, x, y = item[order], band[order], a[order], diagonal[order]
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (b[1:] != b[:-1])]))
            count = np.diff(np.append(new, len(i)))
            enough = count >= self.least[i[new]]
            for s, n in zip(new[enough], count[enough]):
                k, part, at = int(i[s]), y[s : s + n], x[s : s + n]
                # the bound holds for a stretch as long as a passage, not for the band as a whole
                inside = np.searchsorted(at, at + self.short[k] - self.q, "right") - np.arange(n)
                good = np.flatnonzero(inside >= self.least[k])
                if len(good):
                    last = int(at[min(n - 1, good[-1] + inside[good[-1]] - 1)]) + self.q
                    out[k, int(part.min()), int(part.max())] = (k, int(at[good[0]]), last, int(part.min()), int(part.max()))
        return list(out.values())

    def aligned(self, codes: np.ndarray, item: int, a0: int, a1: int, low: int, high: int) -> bool:
        """Whether some stretch of the band aligns with an edit rate within the budget: edits per shortest passage.

        Banded dynamic programming over the item's positions; a row holds the band's diagonals. The score of a cell is
        matched characters minus a penalty an edit that makes a stretch over budget fall below the least passage."""
        x = self.codes[item][a0:a1]
        diagonals = np.arange(low - self.edits, high + self.edits + 1)
        need = int(self.least[item]) + self.q - 1
        at = a0 + np.arange(len(x))[:, None] + diagonals[None, :]
        same = np.zeros(at.shape, bool)
        inside = (at >= 0) & (at < len(codes))
        same[inside] = codes[at[inside]] == np.broadcast_to(x[:, None], at.shape)[inside]
        if _longest_run(same) >= need:  # a stretch without an edit
            return True
        penalty, row, best = self.q, np.zeros(len(diagonals), np.int64), 0
        for s in same:
            stay = np.where(s, row + 1, row - penalty)
            drop = np.append(row[1:], -penalty) - penalty  # a character only the item has
            row = np.maximum(0, np.maximum(stay, drop))
            row[1:] = np.maximum(row[1:], row[:-1] - penalty)  # a character only the document has
            best = max(best, int(row.max()))
            if best >= need:
                return True
        return False

    def holds(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, item: int, low: int, high: int) -> bool:
        """The exact check: on one diagonal, `min_words` words of the item from a word start to a word end."""
        x, s, e = self.codes[item], self.starts[item], self.ends[item]
        for diagonal in range(low, high + 1):
            at = np.arange(len(x)) + diagonal
            ok = (at >= 0) & (at < len(codes))
            same = np.zeros(len(x) + 1, bool)
            same[:-1][ok] = codes[at[ok]] == x[ok]
            wrong = np.concatenate([[0], np.cumsum(~same[:-1])])
            first, last = s[: len(s) - self.min_words + 1], e[self.min_words - 1 :]
            good = wrong[last] == wrong[first]
            if good.any() and (np.isin(first[good] + diagonal, starts) & np.isin(last[good] + diagonal, ends)).any():
                return True
        return False

    def found(self, text: str) -> list[int]:
        codes, starts, ends = letters(text)
        out = set()
        for item, a0, a1, low, high in self.bands(codes):
            if item not in out and self.aligned(codes, item, a0, a1, low, high) and self.holds(codes, starts, ends, item, low, high):
                out.add(item)
        return [self.ids[i] for i in out]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """All items, block by block; the iterator holds one block at a time."""
    block, size = [], 0
    for r in items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).distinct().toLocalIterator():
        if block and size + len(r[1]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def _all_grams(blocks: Iterator[list[tuple[int, str]]], min_words: int) -> tuple[int, np.ndarray, int]:
    """(number of blocks, bitmap of the q-grams of all items, the least number of them that a passage holds)."""
    seen, count, least = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 0, 1 << 62
    for block in blocks:
        count += 1
        index = Index(block, min_words=min_words)
        slot = index.h >> np.uint64(64 - FILTER_BITS)
        np.bitwise_or.at(seen, (slot >> np.uint64(3)).astype(np.int64), (1 << (slot & np.uint64(7))).astype(np.uint8))
        least = min(least, int(index.least.min(initial=1 << 62)))
    return count, seen, least


def _sharing(docs: DataFrame, seen: np.ndarray, least: int, text_col: str) -> DataFrame:
    """The documents that hold at least `least` q-grams of the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)  # of fixed size

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for t in pdf[text_col]:
                slot = grams(letters(t)[0]) >> np.uint64(64 - FILTER_BITS)
                hit = shared.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1
                keep.append(int(hit.sum()) >= least)
            yield pdf[np.array(keep, bool)]

    return docs.mapInPandas(scan, docs.schema)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "item_text", min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, doc_id): each document with each item of which it holds `min_words` consecutive words."""
    spark = docs.sparkSession
    kind = f"{item_id} {items.schema[item_id].dataType.simpleString()}, {doc_id} {docs.schema[doc_id].dataType.simpleString()}"
    read = docs.select(doc_id, text_col).where(F.col(text_col).isNotNull() & F.col(doc_id).isNotNull())
    count, seen, least = _all_grams(_blocks(items, item_id, item_text), min_words)
    if count > 1:
        read = written(_sharing(read, seen, least, text_col))
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value, min_words=min_words)
            for pdf in batches:
                pairs = [(i, d) for d, t in zip(pdf[doc_id], pdf[text_col]) if t for i in index.found(t)]
                yield pd.DataFrame(pairs, columns=[item_id, doc_id])

        part = read.mapInPandas(scan, kind)
        out = part if out is None else out.unionByName(part)
    return (spark.createDataFrame([], kind) if out is None else out).distinct()
