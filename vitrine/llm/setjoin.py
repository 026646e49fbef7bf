"""Exact set-similarity self-join (Jaccard) of the lines or the whole texts of a table.

A unit is a line with its distinct words, or a text with its distinct shingles (A-Z lowered). Units with equal token sets
are one class. Classes link at a similarity of at least `t`:

1. Token frequencies go into hashed counters, whose number follows the table's size. They order every unit's tokens by
   rarity (class of frequency above the counters' median, then hash): the same total order everywhere.
2. Prefix filter: of n tokens, the n - ceil(t n) + 1 rarest get a posting (token, the token before, class, n, position,
   parity words). Two classes that link share a prefix token. Postings travel packed, in runs for each of many parts of
   the token space.
3. Within a token, pairs are tested by length, by position (the tokens left must allow the overlap) and by the parity
   words (their Hamming distance is at most the symmetric difference; units too large for them have none and pass);
   pairs that share the token before as well meet there. Only classes with a partner stay. A token whose counter says that it is hot is split into blocks of classes,
   and each pair of blocks is a cell of its own.
4. Those classes get their token sets, and each token's group is verified exactly, as products of 0/1 matrices, in pairs
   of blocks of bounded size. A pair counts where its first common prefix token is, so it counts once; of groups with the
   same members, only the first can have such pairs and is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, between, cut, hash_order, mix, release, scratch_path, shuffle_partitions, text_chunks, trimmed, words
from .components import connected_components

#: Bits that number the counters at least and at most; a counter has four bytes in a task and one when broadcast.
COUNTER_BITS = (20, 22)
#: Bits of the map of wanted classes at least and at most; it is broadcast. False hits only cost time.
FILTER_BITS = (22, 28)
#: Postings of a token, by its counter, from which it is split; classes that are verified in one block.
HOT, BLOCK = 8192, 1024
#: Parts of the token space for each shuffle partition; a task holds the postings of one part at a time.
PARTS = 16
#: Postings that a task holds before it sends them on.
HELD = 1 << 17
#: Entries of a verification matrix at most; wider ones are multiplied in slices.
ENTRIES = 1 << 22
#: Classes of a component of candidates, or of a part of a larger one, that are verified together when only links are asked for.
TOGETHER = 256
#: Groups up to this size are compared as sets, pair by pair, with the same results.
SMALL = 8
_HASH_BITS = 56
_HASH = np.uint64((1 << _HASH_BITS) - 1)


class Units:
    """The units of a chunk and their distinct tokens, grouped by unit (CSR: tokens[at[k]:at[k + 1]]), rarest first.

    Lines: `shingle` is 0 and `number` counts lines from 0. Texts: `shingle` is a number of words; a text with fewer is
    one shingle. Units without words do not appear."""

    def __init__(self, t: Texts, shingle: int = 0, frequency: np.ndarray | None = None):
        h, a, _, doc = words(t)
        if shingle:
            h, unit = _shingles(h, doc, shingle)
            unit = unit.astype(np.int64) << 32
        else:
            breaks = np.flatnonzero(t.data == 10)
            number = between(a, breaks)  # line breaks before the word, over the chunk
            number = number - np.searchsorted(breaks, t.start[:-1])[doc]
            unit = doc.astype(np.int64) << 32 | number
        h = h >> np.uint64(64 - _HASH_BITS)
        if frequency is not None:  # a token is now its rarity class, then its hash: one number, the same everywhere
            h |= frequency[(h & np.uint64(len(frequency) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(_HASH_BITS)
        dense = np.cumsum(np.r_[False, unit[1:] != unit[:-1]]) if len(unit) else unit
        order = hash_order(h)
        order = order[np.argsort(dense[order].astype(np.uint16 if len(dense) and dense[-1] < 1 << 16 else np.uint32), kind="stable")]
        h, unit = h[order], unit[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])] if len(h) else np.zeros(0, bool)
        self.tokens, unit = h[first], unit[first]
        begin = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
        self.at = np.r_[begin, len(unit)].astype(np.int64)
        self.doc, self.number = unit[begin] >> 32, unit[begin] & 0xFFFFFFFF
        self.n = np.diff(self.at)
        # The class: the sum of the tokens' mixed hashes, mixed with their number.
        self.key = mix(np.add.reduceat(mix(self.tokens & _HASH), begin) + self.n.astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)


def _shingles(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of k words, or of all words of a shorter document."""
    if not len(h):
        return h, doc
    n = len(h)
    pad, of = np.r_[h, np.zeros(k - 1, np.uint64)], np.r_[doc, np.full(k - 1, -1)]
    s = h.copy()
    for j in range(1, k):
        s = mix(s) + np.where(of[j : n + j] == doc, pad[j : n + j], np.uint64(0))
    whole = (of[k - 1 :] == doc) | np.r_[True, doc[1:] != doc[:-1]]
    return mix(s[whole]), doc[whole]


def needed_overlap(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def prefix_sizes(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def rarity_class(count: np.ndarray, background: int = 0) -> np.ndarray:
    """0 for a counter of at most one unit, 1 up to the background, then growing with the logarithm, six steps an octave."""
    return np.where(count > 1, np.minimum(1 + 6 * np.log2(np.maximum(count - background, 1)), 254), 0).astype(np.uint8)


def class_count(rarity: np.ndarray) -> np.ndarray:
    """About the count that a rarity class stands for."""
    return np.where(rarity > 0, np.exp2((rarity.astype(float) - 1) / 6), 1)


_TILE = 1 << 12
_SCAN = "doc_id long, th long, line int, key long, tile long, n binary"


def scan_units(rows: DataFrame, shingle: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, th, text) -> units (doc_id, th, line, key), counters (tile, n) and the counters' bits, in one pass.

    Both are in one table in the shared folder. With shingles every row has a unit; a text without words has key 0."""
    spark = rows.sparkSession
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()  # of the input, as planned
    bits = min(max(size - 10, COUNTER_BITS[0]), COUNTER_BITS[1]) if size < 60 else COUNTER_BITS[0]  # else unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("key", pa.int64()), ("tile", pa.int64()), ("n", pa.binary())])

        def out(size: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        for b in batches:
            for t in text_chunks(b.column(2)):
                x = Units(t, shingle)
                slot, n = np.unique(x.tokens & np.uint64(len(count) - 1), return_counts=True) if len(x.tokens) < len(count) // 8 else (None, None)
                if slot is None:
                    count += np.bincount((x.tokens & np.uint64(len(count) - 1)).astype(np.int64), minlength=len(count)).astype(np.uint32)
                else:
                    count[slot.astype(np.int64)] += n.astype(np.uint32)
                doc, line, key = x.doc, x.number, x.key
                if shingle:
                    key, doc, line = np.zeros(t.n, np.uint64), np.arange(t.n), np.zeros(t.n, np.int64)
                    key[x.doc] = x.key
                who = pa.array(t.first + doc)
                yield out(len(who), doc_id=b.column(0).take(who), th=b.column(1).take(who), line=pa.array(line, pa.int32()), key=pa.array(key.view(np.int64)))
        tiles = count.astype("<u4", copy=False).reshape(-1, _TILE)
        for s in range(0, len(tiles), 64):
            some = tiles[s : s + 64]
            yield out(len(some), tile=pa.array(np.arange(s, s + len(some))), n=pa.array([x.tobytes() for x in some], pa.binary()))

    path = scratch_path(spark, "units")
    rows.select("doc_id", "th", "text").mapInArrow(trimmed(run), _SCAN).write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(_SCAN).parquet(path)
    return found.where("tile is null").select("doc_id", "th", "line", "key"), found.where("tile is not null").select("tile", "n"), bits


def frequencies(tiles: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Rarity class of each counter, from every unit that holds its tokens, and the sum of all counters.

    The tasks' counters are summed by tile; a fixed number of counters reaches the driver, in a few bytes each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([np.minimum(x, (1 << 32) - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], ["k", "n"])

    out = np.zeros((1 << bits) // _TILE * _TILE, np.uint32).reshape(-1, _TILE)
    for r in tiles.repartition("tile").mapInArrow(add, "k long, n binary").toLocalIterator():
        out[r["k"]] = np.frombuffer(r["n"], "<u4")
    flat = out.ravel()
    background = int(np.median(flat))  # what rare tokens alone put into a counter
    return rarity_class(flat.astype(np.int64), background), int(flat.sum(dtype=np.int64))


def telling(n: np.ndarray, t: float) -> np.ndarray:
    """Whether units of n tokens are small enough for parity words to tell them apart: unrelated units differ in about 64
    of 128 bits, units that link in at most as many as their symmetric difference allows."""
    return 2 * n * (1 - t) < 64 * (1 + t)


def _parity(x: Units, t: float) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two words: how often, modulo 2, a unit's tokens hash to each; zeros, which pack away, for large units."""
    tokens, begin, small = x.tokens, x.at[:-1], telling(x.n, t)
    bit = np.uint64(1) << ((tokens >> np.uint64(40)) & np.uint64(63))
    high = (tokens >> np.uint64(46)) & np.uint64(1) == 1
    zero = np.uint64(0)
    words_ = np.where(high, zero, bit), np.where(high, bit, zero)
    return tuple(np.where(small, np.bitwise_xor.reduceat(w, begin), zero) for w in words_)


#: `low` and `high` are the last 48 bits of the unit's token before, and 0 for its first.
_POSTING = np.dtype([
    ("token", "<u8"), ("key", "<u8"), ("parity", "<u8"), ("more", "<u8"), ("low", "<u4"), ("high", "<u2"), ("n", "<u4"), ("pos", "<u4"), ("cell", "<u4")])


def _packed(x: np.ndarray) -> bytes:
    """Postings byte by byte: the first bytes of all, then the second ones; the many zeros lie together."""
    return x.view(np.uint8).reshape(len(x), _POSTING.itemsize).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(_POSTING.itemsize, -1).T).view(_POSTING).ravel()


def _cells(token: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells: a posting of a hot token is there once for each cell of its block.

    A cell is a pair of blocks, the lower one in the upper half of the number; all else is cell 0 (block 0 with itself)."""
    blocks = np.ceil(class_count((token >> np.uint64(_HASH_BITS)).astype(np.uint8)) / HOT).astype(np.int64)
    blocks = np.clip(blocks, 1, 1 << 15)
    if (blocks == 1).all():
        return np.arange(len(token)), np.zeros(len(token), np.int64)
    mine = (mix(key) % blocks.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(token)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return row, np.minimum(mine[row], other) << 16 | np.maximum(mine[row], other)


def _postings(rows: DataFrame, frequency, t: float, shingle: int, parts: int) -> DataFrame:
    """(part, postings): the prefix tokens' postings of every class, in packed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, count = frequency.value, [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            part = (mix(x["token"] ^ mix(x["cell"].astype(np.uint64))) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, x = part[order], x[order]
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            blobs = [_packed(x[a:b]) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(x)])]
            return pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(blobs, pa.binary())], ["part", "postings"])

        for b in batches:
            for chunk in text_chunks(b.column(0)):
                x = Units(chunk, shingle, table)
                if not len(x.n):
                    continue
                _, one = np.unique(x.key, return_index=True)  # a class that repeats here needs one posting
                parity = _parity(x, t)
                size = prefix_sizes(x.n[one], t)
                unit = np.repeat(one, size)
                pos = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
                token = x.tokens[x.at[unit] + pos]
                shared = token >> np.uint64(_HASH_BITS) > 0  # class 0: in one unit only
                unit, pos, token = unit[shared], pos[shared], token[shared]
                before = np.where(pos > 0, x.tokens[np.maximum(x.at[unit] + pos - 1, 0)], np.uint64(0))
                row, cell = _cells(token, x.key[unit])
                p = np.empty(len(row), _POSTING)
                p["token"], p["pos"], p["cell"], unit = token[row], pos[row], cell, unit[row]
                p["key"], p["n"], p["parity"], p["more"] = x.key[unit], x.n[unit], parity[0][unit], parity[1][unit]
                p["low"], p["high"] = before[row] & np.uint64(0xFFFFFFFF), before[row] >> np.uint64(32) & np.uint64(0xFFFF)
                held.append(p)
                count += len(p)
                if count >= HELD:
                    yield out()
                    held, count = [], 0
        if count:
            yield out()

    return rows.select("text").mapInArrow(trimmed(run), "part int, postings binary")


def with_partner(token, n, key, pos, parity, more, before, side, t: float) -> np.ndarray:
    """Rows that pass the filters with another row of their token. Rows are sorted by (token, n, key); `before` is their
    token before or 0, and `side` is 0, or 1 and 2 in a cell of two blocks, where only pairs across them count."""
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    active, small = np.zeros(len(token), bool), telling(n, t)
    i = np.arange(len(token) - 1)
    step = 1
    while True:
        i = i[i + step < len(token)]
        j = i + step
        go = (token[j] == token[i]) & (t * n[j] <= n[i] + 1e-9)  # length filter; rows are sorted by n
        i, j = i[go], j[go]
        if not len(i):
            return active
        need = needed_overlap(n[i], n[j], t)
        ok = (key[i] != key[j]) & (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= need)
        far = np.bitwise_count(parity[i] ^ parity[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])
        ok &= (far <= n[i] + n[j] - 2 * need) | ~small[i] | ~small[j]
        ok &= (before[i] == 0) | (before[i] != before[j])
        ok &= (side[i] == 0) | (side[i] != side[j])
        active[i[ok]] = True
        active[j[ok]] = True
        step += 1


_ACTIVE = "token long, key long, part long, block int, members long"


def _active_part(x: np.ndarray, t: float) -> pa.RecordBatch | None:
    """(token, key, part, block, members) of the classes of one part that have a possible partner; part numbers the pair
    of blocks of a large group within its cell, members is a hash of who is in it."""
    order = np.argsort(x["token"])
    token = x["token"][order]
    same = token[1:] == token[:-1]
    x = x[order[np.r_[same, False] | np.r_[False, same]]]  # a token that is there once has no pair
    x = x[np.lexsort((x["key"], x["n"], x["cell"], x["token"]))]
    if not len(x):
        return None
    group = x["token"] ^ mix(x["cell"].astype(np.uint64))  # tokens of different cells are different groups
    fresh = np.r_[True, (group[1:] != group[:-1]) | (x["key"][1:] != x["key"][:-1])]  # a class may come from many chunks
    x, group = x[fresh], group[fresh]
    low, high = (x["cell"] >> 16).astype(np.int64), (x["cell"] & 0xFFFF).astype(np.int64)
    blocks = np.clip(np.ceil(class_count((x["token"] >> np.uint64(_HASH_BITS)).astype(np.uint8)) / HOT), 1, 1 << 15).astype(np.uint64)
    side = np.where(low == high, 0, np.where((mix(x["key"]) % blocks).astype(np.int64) == low, 1, 2))
    before = x["high"].astype(np.uint64) << np.uint64(32) | x["low"]
    good = with_partner(group, x["n"], x["key"], x["pos"], x["parity"], x["more"], before, side, t)
    x, group, side = x[good], group[good], side[good]
    if not len(x):
        return None
    order = np.lexsort((side, group))
    x, group, side = x[order], group[order], side[order]
    first = np.r_[True, group[1:] != group[:-1]]
    begin = np.flatnonzero(first)
    size = np.diff(np.r_[begin, len(x)])
    mine = (np.arange(len(x)) - np.repeat(begin, size)) // BLOCK
    count = np.repeat(-(-size // BLOCK), size)
    row = np.repeat(np.arange(len(x)), count)  # a member of block b joins the parts {b, c} of every c
    other = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    part = x["cell"][row].astype(np.int64) << 32 | np.minimum(mine[row], other) << 16 | np.maximum(mine[row], other)
    # Within a cell of two blocks the sides tell what may pair; else the blocks of a part do, where it has two.
    two = count[row] > 1
    tag = np.where(two, mine[row] + 1, 0) * 4 + side[row]
    _, at = np.unique(mix(group[row] ^ mix(part.view(np.uint64) + np.uint64(1))), return_inverse=True)
    members = np.zeros(int(at.max()) + 1, np.uint64)
    np.add.at(members, at, mix(x["key"][row] ^ mix(tag.astype(np.uint64) + np.uint64(2))))
    return pa.RecordBatch.from_arrays(
        [pa.array(x["token"][row].view(np.int64)), pa.array(x["key"][row].view(np.int64)), pa.array(part), pa.array(tag, pa.int32()),
         pa.array(members[at].view(np.int64))], ["token", "key", "part", "block", "members"])


def _active(postings: DataFrame, t: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != now and held:
                    if (out := _active_part(np.concatenate(held), t)) is not None:
                        yield out
                    held = []
                now = part
                held.append(_unpacked(raw))
        if held and (out := _active_part(np.concatenate(held), t)) is not None:
            yield out

    return postings.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(run), _ACTIVE)


def in_filter(have: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a bitmap may hold each key; it has no false misses."""
    slot = key & np.uint64(64 * len(have) - 1)
    return (have[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap that holds every `key` (long); its size follows their number, within FILTER_BITS."""
    n = keys.count()
    bits = min(max((8 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words_ = keys.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast((key & {(1 << bits) - 1}) % 64 as int))").alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in words_.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = np.int64(r["b"]).view(np.uint64)
    return out


def _sets(rows: DataFrame, frequency, bits, shingle: int) -> DataFrame:
    """(key, tokens): the token sets, rarest first, of the units whose class the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, have = frequency.value, bits.value
        for b in batches:
            for chunk in text_chunks(b.column(0)):
                x = Units(chunk, shingle, table)
                pick = np.flatnonzero(in_filter(have, x.key))
                if not len(pick):
                    continue
                _, one = np.unique(x.key[pick], return_index=True)
                pick = pick[one]
                raw = x.tokens.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.key[pick].view(np.int64)),
                     pa.array([raw[8 * x.at[k] : 8 * x.at[k + 1]] for k in pick.tolist()], pa.binary())], ["key", "tokens"])

    return rows.select("text").mapInArrow(trimmed(run), "key long, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))


def may_pair(tag: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether members with these tags are a pair of their part: of different blocks if it has two, of different sides
    if its cell has two. In a part of one block its own pairs count, in a part of two only those across."""
    block, side = tag[:, None] >> 2, tag[:, None] & 3
    blocks, sides = other[None, :] >> 2, other[None, :] & 3
    return ((block != blocks) | (not _two(tag, other))) & ((side == 0) | (side != sides))


def _two(tag: np.ndarray, other: np.ndarray) -> bool:
    return len(np.unique(np.r_[tag >> 2, other >> 2])) > 1


def similar_pairs(tokens: list[np.ndarray], tag: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of all pairs (both ways) with a similarity of at least t, by exact overlaps."""
    size = np.array([len(x) for x in tokens], np.int64)
    row = np.repeat(np.arange(len(tokens)), size)
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    use = count[column] > 1
    name = (np.cumsum(count > 1) - 1)[column[use]]
    row, width = row[use], int((count > 1).sum())
    step = max(1, ENTRIES // len(tokens))
    overlap = np.zeros((len(tokens), len(tokens)), np.float32)
    for at in range(0, width, step):
        pick = (name >= at) & (name < at + step)
        full = np.zeros((len(tokens), min(step, width - at)), np.float32)
        full[row[pick], name[pick] - at] = 1
        overlap += full @ full.T
    good = overlap >= needed_overlap(size[:, None], size[None, :], t)
    good &= may_pair(tag, tag)
    np.fill_diagonal(good, False)
    return np.nonzero(good)


def verify_group(token: int, tokens: list[np.ndarray], tag: np.ndarray, order: np.ndarray, t: float):
    """Links and earlier flags of one token's classes (of one pair of blocks), by exact Jaccard similarity.

    `order` ranks the classes by first unit. A pair counts if `token` is its first common prefix token."""
    i, j = similar_pairs(tokens, tag, t)
    links, earlier = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
    if len(i):
        # Prefix tokens before this one, of the classes in a pair: a pair that shares one counts there.
        near = np.unique(i)
        early = [tokens[k][: min(int(np.searchsorted(tokens[k], np.uint64(token))), int(prefix_sizes(np.array([len(tokens[k])]), t)[0]))] for k in near.tolist()]
        at = np.searchsorted(near, i), np.searchsorted(near, j)
        shares = np.zeros((len(near), len(near)), bool)
        size = np.array([len(x) for x in early])
        if size.any():
            _, column = np.unique(np.concatenate(early), return_inverse=True)
            width = int(column.max()) + 1
            row = np.repeat(np.arange(len(near)), size)
            step = max(1, ENTRIES // len(near))
            for a in range(0, width, step):
                pick = (column >= a) & (column < a + step)
                full = np.zeros((len(near), min(step, width - a)), np.float32)
                full[row[pick], column[pick] - a] = 1
                shares |= full @ full.T > 0
        here = ~shares[at]
        i, j = i[here], j[here]
        links += np.bincount(i, minlength=len(tokens))
        earlier[i[order[j] < order[i]]] = True
    return links, earlier


def verify_few(token: int, tokens: list[np.ndarray], tag: np.ndarray, order: np.ndarray, t: float):
    """verify_group for a few classes, without matrices."""
    rows = [x.tolist() for x in tokens]
    full = [set(x) for x in rows]
    prefix = [set(x[: len(x) - math.ceil(t * len(x) - 1e-9) + 1]) for x in rows]
    links, earlier = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    pair = may_pair(tag, tag)
    for i in range(len(rows)):
        for j in range(i):
            n, m = len(rows[i]), len(rows[j])
            if not pair[i, j] or min(n, m) < t * max(n, m) - 1e-9:
                continue
            if len(full[i] & full[j]) >= math.ceil(t / (1 + t) * (n + m) - 1e-9) and min(prefix[i] & prefix[j]) == token:
                links[i] += 1
                links[j] += 1
                earlier[i if order[j] < order[i] else j] = True
    return links, earlier


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) that span the same components as the pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            k = np.flatnonzero(label != np.arange(n))
            return k, label[k]
        label = new


def _by_group(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple]]:
    """Rows in runs of equal first and second column."""
    now, held = None, []
    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(columns))):
            if r[:2] != now:
                if len(held) > 1:
                    yield held
                now, held = r[:2], []
            held.append(r)
    if len(held) > 1:
        yield held


def verified_counts(groups: DataFrame, t: float) -> DataFrame:
    """(token, part, block, key, tokens, f1, f2, f3) -> (key, links, earlier), summed over tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, 8):
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            order = np.empty(len(rows), np.int64)
            order[sorted(range(len(rows)), key=lambda k: tuple((x is None, x) for x in rows[k][5:8]))] = np.arange(len(rows))
            token, tag = rows[0][0] % (1 << 64), np.array([r[2] for r in rows])
            links, earlier = (verify_few if len(rows) <= SMALL else verify_group)(token, sets, tag, order, t)
            k = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][3] for i in k], pa.int64()), pa.array(links[k]), pa.array(earlier[k])], ["key", "links", "earlier"])

    spread = groups.repartition("token", "part").sortWithinPartitions("token", "part")
    found = spread.mapInArrow(trimmed(run), "key long, links long, earlier boolean")
    return found.groupBy("key").agg(F.sum("links").alias("links"), F.max("earlier").alias("earlier"))


def verified_links(groups: DataFrame, t: float) -> DataFrame:
    """(token, part, block, key, tokens) -> (u, v): links that span the components of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches, 5):
            i, j = similar_pairs([np.frombuffer(r[4], np.uint64) for r in rows], np.array([r[2] for r in rows]), t)
            if len(i):
                u, v = forest(i, j, len(rows))
                key = np.array([r[3] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(key[u]), pa.array(key[v])], ["u", "v"])

    return groups.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(trimmed(run), "u long, v long").distinct()


def _by_component(active: DataFrame) -> DataFrame:
    """Groups that share members put together, where they stay small: each class then travels once, not once a token.

    A component of more than TOGETHER classes keeps its tokens' groups. All candidate pairs stay within a group."""
    hubs = active.groupBy("token", "part").agg(F.min("key").alias("hub"))
    comp = cut(connected_components(active.join(hubs, ["token", "part"]).select(F.col("key").alias("u"), F.col("hub").alias("v"))))
    small = comp.groupBy("component").count().where(F.col("count") <= TOGETHER).select("component")
    together = comp.join(small, "component").select(
        F.col("component").alias("token"), F.col("node").alias("key"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("block"))
    large = comp.join(small, "component", "left_anti").select(F.col("node").alias("key"))
    return cut(together.unionByName(active.join(large, "key", "left_semi").select("token", "key", "part", "block")))


def with_sets(groups: DataFrame, rows: DataFrame, frequency, shingle: int = 0) -> DataFrame:
    """(token, part, block, key) and the rows (text, ...) of its classes -> (token, part, block, key, tokens)."""
    wanted = rows.sparkSession.sparkContext.broadcast(key_filter(groups.select("key").distinct()))
    sets = _sets(rows, frequency, wanted, shingle).withColumnRenamed("key", "k")
    return groups.join(sets, F.col("key") == F.col("k")).select("token", "part", "block", "key", "tokens")


def _across(active: DataFrame, known: DataFrame) -> DataFrame:
    """The groups whose members are not all in one component of `known` (node, component): only those have new links."""
    side = active.join(known, F.col("key") == F.col("node"), "left").select("token", "part", F.coalesce("component", "key").alias("c"))
    new = side.groupBy("token", "part").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return active.join(new, ["token", "part"], "left_semi")


def broadcast_frequencies(rows: DataFrame, tiles: DataFrame, bits: int):
    """The rarity classes, broadcast, and the sum of all counters."""
    table, total = frequencies(tiles, bits)
    return rows.sparkSession.sparkContext.broadcast(table), total


def candidate_groups(
    rows: DataFrame, counted, t: float, shingle: int = 0, links_only: bool = False, known: DataFrame | None = None
) -> DataFrame:
    """Rows (text, ...) and what broadcast_frequencies gave -> (token, part, block, key, tokens): the groups to verify.

    With links_only, a pair may be in any group, in several or in one; else it is where its first common token is. Links
    within the components of `known` (node, component) are not looked for again."""
    spark = rows.sparkSession
    frequency, total = counted
    waiting = (total * (1 - t) + 1) * _POSTING.itemsize
    parts = PARTS * max(shuffle_partitions(spark), int(waiting / (PARTS * (16 << 20))))
    active = cut(_active(_postings(rows, frequency, t, shingle, parts), t))
    release(spark)  # the postings
    # Groups with the same members have the same pairs, and those count at the first token: the others are not needed.
    place = F.struct(F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("token"), "part")  # tokens are unsigned
    first = active.groupBy("members").agg(F.min(place).alias("first"))
    active = cut(active.join(first, "members").where(place == F.col("first")).select("token", "key", "part", "block"))
    if known is not None:
        active = cut(_across(active, known))
    if links_only:
        active = _by_component(active)
    return with_sets(active, rows, frequency, shingle)
