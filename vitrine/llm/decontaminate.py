"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased (A-Z) and runs of ASCII white space become one space. A test item of m bytes may occur with up to
k = m * ERRORS edits. It is split into k + 1 pieces: an occurrence with k edits leaves one piece whole, so every exact
piece hit (Aho-Corasick over all items' pieces) is a candidate, and only they are. A candidate's window is verified by
Myers' bit-parallel distance, with the item in one machine integer of m bits.

Items are worked on in blocks of bounded size, one pass over the documents each, so no automaton grows with the
benchmark; blocks are cut by item, and the items' texts reach the driver one block at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_texts, only, prepare

#: Edits allowed a byte of the item.
ERRORS = 0.06
#: Bytes of items in one block.
BLOCK_BYTES = 4 << 20
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(text: str | None) -> bytes:
    return _SPACES.sub(b" ", (text or "").encode("utf-8", "replace").lower()).strip()


def budget(item: bytes, errors: float = ERRORS) -> int:
    return int(len(item) * errors)


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """(offset, piece): k + 1 pieces of about equal size that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern_bits: dict[int, int], m: int, text: bytes, limit: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of `text`, and that substring's end (least end first).

    Stops early only at distance 0; a result above `limit` means none within it."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    get = pattern_bits.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | (~(xh | vp) & full)
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full  # the first row is free: the match may start anywhere
        hn = (hn << 1) & full
        vp = hn | (~(xv | hp) & full)
        vn = hp & xv
        if score < best:
            best, end = score, at + 1
            if best == 0:
                break
    return (best, end) if best <= limit else (limit + 1, 0)


class ItemIndex:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], errors: float = ERRORS):
        import ahocorasick

        self.items: list[tuple[int, bytes, int, dict[int, int]]] = []
        where: dict[bytes, list[tuple[int, int]]] = {}
        for item_id, text in items:
            x = normalise(text)
            if not x:
                continue
            k = budget(x, errors)
            bits: dict[int, int] = {}
            for i, c in enumerate(x):
                bits[c] = bits.get(c, 0) | (1 << i)
            for offset, piece in pieces(x, k):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, x, k, bits))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():  # bytes as Latin-1, so that positions are byte positions
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of every item that occurs within its budget, ascending."""
        return sorted(self._matches(text))

    def holds(self, text: str | None) -> bool:
        """Whether any item occurs within its budget."""
        return next(self._matches(text), None) is not None

    def _matches(self, text: str | None) -> Iterator[tuple[int, int]]:
        if self.empty or not text:
            return
        x = normalise(text)
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (length, places) in self.automaton.iter(x.decode("latin-1")):
            for item, offset in places:
                _, pattern, k, _ = self.items[item]
                begin = end + 1 - length - offset
                if begin + len(pattern) + k < len(pattern) - k or begin - k > len(x):
                    continue
                windows.setdefault(item, []).append((max(0, begin - k), min(len(x), begin + len(pattern) + k)))
        for item, spans in windows.items():
            item_id, pattern, k, bits = self.items[item]
            best, reach = k + 1, -1
            for a, b in sorted(set(spans)):
                if b <= reach or b - a < len(pattern) - k:
                    continue
                if x[a + k : a + k + len(pattern)] == pattern:
                    best = 0
                else:
                    best = min(best, myers(bits, len(pattern), x[a:b], k)[0])
                reach = b
                if best == 0:
                    break
            if best <= k:
                yield item_id, best


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    items = only(benchmark, "item_id", "text").where("text is not null and item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    items = items if n == 1 else cut(items)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(int(r["item_id"]), r["text"]) for r in part.orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents and benchmark (item_id, text) -> doc_id, item_id, distance: a row for each document row and item that
    it holds within the item's budget, with the least edit distance over the whole text.

    Null and empty texts hold nothing; null, empty and all-space items are held by nothing. A repeated document row is
    reported again; a repeated item_id with several texts gives its least distance. Rows with a null doc_id are
    reported with it. Empty tables give an empty result; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def scan(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, errors)
            for b in batches:
                who, what, how = [], [], []
                for d, x in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
                    found: dict[int, int] = {}
                    for item, k in index.matches(x):
                        found[item] = min(k, found.get(item, k))
                    who += [d] * len(found)
                    what += found.keys()
                    how += found.values()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, pa.int64()), pa.array(what, pa.int64()), pa.array(how, pa.int64())], ["doc_id", "item_id", "distance"])

        return rows.mapInArrow(run, "doc_id long, item_id long, distance long")

    parts = [scan(items) for items in _blocks(benchmark, block_bytes)]
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, with all their columns.

    Every row is judged by its own text, whatever its doc_id: null and repeated ids are like others, and rows with null
    or empty texts stay. Each block of items is one pass over the rows that are left."""
    for items in _blocks(benchmark, block_bytes):
        docs = keep_texts(docs, _clean(items, errors))
    return docs


def _clean(items: list[tuple[int, str]], errors: float) -> Callable[[pa.Array], np.ndarray]:
    index = _Lazy(items, errors)
    return lambda text: np.array([not index.get().holds(x.as_py()) for x in text], bool)


class _Lazy:
    """An index that is built where it is used: its items travel, its automaton does not."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        self.items, self.errors, self.index = items, errors, None

    def get(self) -> ItemIndex:
        if self.index is None:
            self.index = ItemIndex(self.items, self.errors)
        return self.index
