"""Token-id output: tokenised documents in Re-Pair compressed shards with random access.

Documents are dealt to files by ranges of doc_id and sorted. A file is a run of shards of about SHARD_TOKENS ids; a shard
is one row of a file (part, shard, docs, tokens, payload), has a grammar of its own and decodes alone. A payload is
little-endian:

    magic "RPS2", then uint32: base, rules, documents, symbols; then uint8: bits of a symbol, bits of a length; then
    rules  x (left, right), packed symbols - the nonterminal base + k expands to its left and then its right symbol
    rules  x expansion length in ids, packed
    documents x int64 doc_id, uint8 null mark, uint32 ids, uint32 symbols
    symbols, packed

Packed numbers have the named number of bits each, most significant first; each packed run is filled up to whole bytes.
No rule crosses a document border, so a document is decoded from its own symbols, the rules and their lengths alone.

Re-Pair: pairs of adjacent symbols are replaced by nonterminals, the most frequent first, until no pair occurs MIN_COUNT
times, which is the only stop rule: below it, a rule's two symbols and its length take the bits that it saves. Pairs that
do not touch each other are replaced in the same round; where two overlap, the more frequent one is replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Spans, Texts, by_byte, only, pieces, prepare, scratch_path, text_chunks, trimmed, word_spans

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 19
#: Occurrences from which a rule pays for itself.
MIN_COUNT, PAYS = 5, 4
_MAGIC = b"RPS2"


# ---- tokenising ------------------------------------------------------------------------------------------------


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed vocabulary package keeps `name`."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _kinds() -> bytes:
    """What a byte is to a word: _LETTER, _UPPER or _MARK in ASCII, or 0."""
    table = bytearray(256)
    table[ord("a") : ord("z") + 1] = bytes([_LETTER]) * 26
    table[ord("A") : ord("Z") + 1] = bytes([_UPPER]) * 26
    for c in b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~":  # marks that form a run of their own behind a word: no apostrophe, < > or |
        table[c] = _MARK
    return bytes(table)


def _spelling() -> np.ndarray:
    """Byte -> character of byte-level vocabularies: the printing Latin-1 characters stand for themselves, all other
    bytes for the characters from 256 on, in order. The space stays, as it only parts stems."""
    x = np.arange(256)
    odd = ~((33 <= x) & (x <= 126) | (161 <= x) & (x <= 172) | (174 <= x))
    return np.where(odd & (x != 32), 255 + np.cumsum(odd), x).astype("<u2")


def _spell(raw: bytes) -> str:
    return _SPELLING[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")


_LETTER, _UPPER, _MARK = 1, 2, 4
_KINDS, _SPELLING = _kinds(), _spelling()


class WordEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of the parts of words.

    The vocabulary's normaliser and splitter never join across white space, so a text's ids are its words' ids in
    order. A word of Latin-1 letters and a tail of ASCII marks splits between the two and is lower-cased letter by
    letter, so it is put together from its lower-case stem and its tail; any other word is one part. Stems that are not
    remembered are encoded many at a time: each is one run of letters, which ends with the one id whose token carries
    the end-of-word mark. Where the vocabulary spells bytes as characters, they go to its model spelt so already, past
    normaliser and splitter, which would leave them as they are. The memory is a table of fixed size, in which a part
    takes the slot of its hash; its last eight bytes guard against longer parts that share one."""

    SLOTS, POOL = 1 << 20, 1 << 22
    END = "</w>"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(self.END)]] = True
        self.spelt = self._spelt()
        self.clear()

    def _spelt(self):
        """A tokenizer of the model alone, for stems in the model's own spelling, if that gives the same ids."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        alone = Tokenizer(self.tokenizer.model)
        alone.pre_tokenizer = WhitespaceSplit()
        probe = " ".join([*"abcxyz", *map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]), "over", "naïveté", "straßenbahnen", "señores"])
        spelt = _spell(probe.encode())
        same = alone.encode(spelt, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return alone if same else None

    def clear(self) -> None:
        self.key, self.check = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.start, self.size = np.zeros(self.SLOTS, np.int32), np.full(self.SLOTS, -1, np.int32)
        self.pool, self.used = np.empty(self.POOL, np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stems(self, stems: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stems in a row, and how many each has."""
        flat, sizes = [], []
        for at in range(0, len(stems), 1024):
            part = stems[at : at + 1024]
            raw = b" ".join(part)
            if self.spelt is None:
                ids = np.array(self._ids([raw.decode()])[0], np.uint32)
            else:
                ids = np.array(self.spelt.encode_batch_fast([_spell(raw)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                flat.append(ids)
                sizes.append(np.diff(np.r_[0, cuts]))
            else:  # a vocabulary without such marks: one by one
                some = self._others(part)
                flat.append(some[0])
                sizes.append(some[1])
        return np.concatenate(flat), np.concatenate(sizes)

    def _others(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for at in range(0, len(parts), 8192):
            found = self._ids([w.decode("utf-8", "replace") for w in parts[at : at + 8192]])
            sizes += map(len, found)
            flat += [i for x in found for i in x]
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    @staticmethod
    def _parts(t: Texts) -> tuple[np.ndarray, ...]:
        """The bytes with stems in lower case; start, end and word of each part, and whether it is a stem; each word's start."""
        data = t.data
        a, b = word_spans(t, ~SPACE)
        kind = by_byte(data, _KINDS)
        # Latin-1 letters are 0xC3 and a byte from 0x80 to 0xBF, but for the signs for times (0x97) and divided by (0xB7).
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] - np.uint8(0x80) < 0x40) & (data[1:] | np.uint8(0x20) != 0xB7)
        letter = (kind & (_LETTER | _UPPER) != 0) | latin
        letter[:-1] |= latin[1:]
        letters, marks = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
        np.cumsum(letter, out=letters[1:])
        np.cumsum(kind == _MARK, out=marks[1:])
        n = letters[b] - letters[a]
        cut = a + n
        simple = (n > 0) & (letters[cut] - letters[a] == n) & (marks[b] - marks[a] == b - cut)
        tail = simple & (cut < b)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[a[simple]] = 1
        inside[cut[simple]] -= 1
        upper = np.cumsum(inside[:-1], dtype=np.int8).view(bool) & ((kind == _UPPER) | (latin & (data < 0x9F)))
        data = data + (upper.view(np.uint8) << 5)
        number = 1 + tail
        first = np.cumsum(number) - number
        word = np.repeat(np.arange(len(a)), number)
        start, end, stem = a[word], b[word], np.zeros(len(word), bool)
        end[first[simple]] = cut[simple]
        start[first[tail] + 1] = cut[tail]
        stem[first[simple]] = True
        return data, start, end, word, stem, a

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all documents in a row, and how many each has."""
        if self.used > self.POOL:
            self.clear()
        data, a, b, word, stem, begin = self._parts(t)
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(t.n, np.int64)
        spans = Spans(data)
        h, check = spans.hashes(a, b), spans.tails(a, b)
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        start, size = self.start[slot], self.size[slot].astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != h) | (self.check[slot] != check) | (size < 0))
        if len(miss):
            _, rep, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            if (check[miss] != check[miss[rep]][inverse]).any():
                _, rep, inverse = np.unique(np.stack([h[miss], check[miss]], 1), axis=0, return_index=True, return_inverse=True)
            rep = miss[rep]
            order = np.argsort(~stem[rep], kind="stable")  # stems first
            rep, inverse = rep[order], np.argsort(order)[inverse.ravel()]
            raw, stems = data.tobytes(), int(stem[rep].sum())
            new = [raw[x:y] for x, y in zip(a[rep].tolist(), b[rep].tolist())]
            got = [f(x) for f, x in ((self._stems, new[:stems]), (self._others, new[stems:])) if x]
            flat, n = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]).astype(np.int64)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.empty(len(flat) + len(self.pool) // 2, np.uint32)])
            self.pool[self.used : self.used + len(flat)] = flat
            at = self.used + np.cumsum(n) - n
            self.used += len(flat)
            start[miss], size[miss] = at[inverse], n[inverse]
            s = slot[rep]
            self.key[s], self.check[s], self.start[s], self.size[s] = h[rep], check[rep], at, n
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        first = np.searchsorted(begin[word], t.start)  # first part of each document
        return ids, np.diff(np.r_[0, ends][first])


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---- Re-Pair ---------------------------------------------------------------------------------------------------


_TABLE, _SORT, _SPREAD, _FEW = 18, 4096, np.int64(0x1E3779B97F4A7C15), 32


def _ranked(pair: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique with inverse and counts, of pairs of symbols of `bits` bits each. Where a pair and its place fit into one
    number, that is sorted: several times as fast as an order of the pairs."""
    low = len(pair).bit_length()
    if 2 * bits + low > 63:
        return np.unique(pair, return_inverse=True, return_counts=True)
    x = np.sort(((pair >> 32) << bits | (pair & 0xFFFFFFFF)) << low | np.arange(len(pair)))
    order = x & ((1 << low) - 1)
    x >>= low
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    begin = np.flatnonzero(first)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(first) - 1
    return pair[order[begin]], which, np.diff(np.r_[begin, len(x)])


def repair(ids: np.ndarray, last: np.ndarray, base: int, min_count: int = MIN_COUNT):
    """Compresses `ids`; `last` marks the last id of each document. Returns symbols, their last marks, the rules (n, 2)
    and the number of ids that each expands to.

    Symbols are a linked list. A pair's count never grows once both its symbols exist, so a round only looks at places
    whose pair was frequent before or touches a new nonterminal."""
    n = len(ids)
    s, last = ids.astype(np.int64), last.copy()
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    rank = np.full(n + 2, n, np.int32)  # of the pair that begins here; the places n and -1 stand for none
    gone, again = np.zeros(n, bool), np.zeros(n, bool)
    rules, lengths, made = [], [], 0
    length = np.ones(0, np.int64)
    at = np.flatnonzero(~last[:-1]) if n else np.zeros(0, np.int64)
    while len(at):
        pair = s[at] << 32 | s[after[at]]
        if len(at) > _SORT:  # a table of counters by hash spares most pairs the sort
            h = pair * _SPREAD >> (64 - _TABLE) & ((1 << _TABLE) - 1)
            hot = np.bincount(h, minlength=1 << _TABLE)[h] >= min_count
            at, pair = at[hot], pair[hot]
        value, which, count = _ranked(pair, int(base + made).bit_length())
        often = count[which] >= min_count
        at, which = at[often], which[often]
        if not len(at):
            break
        place = np.empty(len(value), np.int32)
        place[np.argsort(-count, kind="stable")] = np.arange(len(value))
        mine = place[which]
        # Runs of one overlapping pair: every other place, from the left.
        head = np.r_[True, (after[at[:-1]] != at[1:]) | (mine[1:] != mine[:-1])]
        k = np.arange(len(at))
        even = (k - np.maximum.accumulate(np.where(head, k, 0))) % 2 == 0
        rank[at[even]] = mine[even]
        wins = even & (rank[before[at]] > mine) & (rank[after[at]] > mine)
        rank[at] = n
        used = np.bincount(which[wins], minlength=len(value))
        keep = (used >= PAYS) | ((place == 0) & (used > 0))  # the most frequent pair is always replaced, so every round ends shorter
        wins &= keep[which]
        number = np.cumsum(keep) - 1 + made
        left, right = value[keep] >> 32, value[keep] & 0xFFFFFFFF
        rules.append(np.stack([left, right], 1))
        of = lambda x: np.where(x < base, 1, length[np.maximum(x - base, 0)] if made else 1)
        length = np.r_[length, of(left) + of(right)]
        made += int(keep.sum())
        i = at[wins]
        j = after[i]
        s[i] = base + number[which[wins]]
        last[i] = last[j]
        gone[j] = True
        after[i] = after[j]
        inner = after[i] < n
        before[after[i][inner]] = i[inner]
        # Places to look at again: what was frequent and stays, and the neighbours of new symbols.
        prior = before[i]
        touched = at[~wins], i, prior[prior >= 0]
        if len(at) < n // _FEW:  # a sort of the few is faster than a pass over all places
            at = np.sort(np.concatenate(touched))
            at = at[np.r_[True, at[1:] != at[:-1]] & ~gone[at]]
        else:
            for x in touched:
                again[x] = True
            again[j] = False
            at = np.flatnonzero(again)
            again[at] = False
        at = at[~last[at]]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return s[~gone], last[~gone], table, length


def pack(x: np.ndarray, bits: int) -> bytes:
    """Numbers of `bits` bits each, most significant first."""
    wide = np.unpackbits(x.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack(raw: np.ndarray, bits: int, a: int, b: int) -> np.ndarray:
    """Numbers a to b (exclusive) of a packed run."""
    first = a * bits // 8
    flat = np.unpackbits(raw[first : -(-b * bits // 8)])[a * bits - 8 * first :][: (b - a) * bits]
    wide = np.zeros((b - a, 32), np.uint8)
    wide[:, 32 - bits :] = flat.reshape(-1, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.int64)


def encode_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, base: int) -> bytes:
    """One shard's payload from the ids of its documents in a row. Every document's ids end with the end id already."""
    base = max(base, int(ids.max(initial=0)) + 1)
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    s, last, rules, lengths = repair(ids, last, base)
    symbols = np.diff(np.r_[0, np.flatnonzero(last) + 1])
    bits = int(base + len(rules)).bit_length()
    long = int(lengths.max(initial=1)).bit_length()
    return b"".join((
        _MAGIC, struct.pack("<4I2B", base, len(rules), len(doc_ids), len(s), bits, long),
        pack(rules.ravel(), bits), pack(lengths, long),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        sizes.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(),
        pack(s, bits),
    ))


class Shard:
    """Reads a payload; `document(k)` decodes one document from its own symbols."""

    def __init__(self, payload: bytes):
        if payload[:4] != _MAGIC:
            raise ValueError("not a shard of token ids")
        self.base, n_rules, n, m, self.bits, long = struct.unpack_from("<4I2B", payload, 4)
        raw, at = np.frombuffer(payload, np.uint8), 22

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return raw[at - size : at]

        self.rules = unpack(take(-(-2 * n_rules * self.bits // 8)), self.bits, 0, 2 * n_rules).reshape(-1, 2)
        self.lengths = unpack(take(-(-n_rules * long // 8)), long, 0, n_rules)
        ids, null = take(8 * n).view("<i8"), take(n)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.sizes = take(4 * n).view("<u4").astype(np.int64)
        self.symbol_ends = np.cumsum(take(4 * n).view("<u4").astype(np.int64))
        self.symbols, self.n_symbols = raw[at:], m

    def expand(self, s: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for. The lengths say where each half of a nonterminal goes."""
        of = lambda x: np.where(x < self.base, 1, self.lengths[np.maximum(x - self.base, 0)]) if len(self.lengths) else np.ones(len(x), np.int64)
        size = of(s)
        out = np.empty(int(size.sum()), np.int64)
        at = np.cumsum(size) - size
        while len(s):
            deep = s >= self.base
            out[at[~deep]] = s[~deep]
            pairs, at = self.rules[s[deep] - self.base], at[deep]
            s = pairs.ravel()
            at = np.stack([at, at + of(pairs[:, 0])], 1).ravel()
        return out

    def document(self, k: int) -> np.ndarray:
        a = int(self.symbol_ends[k - 1]) if k else 0
        return self.expand(unpack(self.symbols, self.bits, a, int(self.symbol_ends[k])))

    def documents(self) -> Iterator[tuple[int | None, memoryview]]:
        """(doc_id, ids as little-endian uint32) of every document, in order."""
        raw, at = memoryview(self.expand(unpack(self.symbols, self.bits, 0, self.n_symbols)).astype("<u4").tobytes()), 0
        for d, n in zip(self.doc_ids, self.sizes.tolist()):
            yield d, raw[4 * at : 4 * (at + n)]
            at += n


# ---- operator --------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Tokenises every document and writes the files to `path`, in ascending doc_id order (null ids first).

    Rows are dealt by ranges of (doc_id, hash of the text, place of the row), so that an id that fills a third of the
    table is spread over several files."""
    spark = prepare(docs.sparkSession)
    where = tokenizer or tokenizer_path()
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    keys = (F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place"))
    dealt = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    sorted_ = dealt.sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(where), TaskContext.get().partitionId()
        shard, names, sizes, held, total = 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            n, ids = np.concatenate(sizes), np.concatenate(held)
            payload = encode_shard(names, n, ids, vocabulary)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (shard, pa.int32()), (len(names), pa.int64()), (total, pa.int64()), (payload, pa.binary()))],
                ["part", "shard", "docs", "tokens", "payload"],
            )

        for b in batches:
            for t in text_chunks(b.column(1)):
                got = [encoder.encode(x) for x in pieces(t)]
                ids = np.concatenate([x for x, _ in got]) if len(got) > 1 else got[0][0]
                n = got[0][1] if len(got) == 1 else np.array([len(ids)])
                held.append(np.insert(ids, np.cumsum(n), end_id))
                sizes.append(n + 1)
                names += b.column(0).slice(t.first, t.n).to_pylist()
                total += len(held[-1])
                if total >= SHARD_TOKENS:
                    yield out()
                    shard, names, sizes, held, total = shard + 1, [], [], [], 0
        if names:
            yield out()

    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(where).get_vocab_size(), end_id + 1)
    sorted_.mapInArrow(trimmed(write), "part int, shard int, docs long, tokens long, payload binary").write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Files -> doc_id, start (ids of all documents before it), n_tokens, ids_crc32: one row for each document."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "shard", "tokens")
    # Offsets in two steps: shards within their part, then the parts, of which there are as many as files.
    inner = sizes.withColumn("inner", F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens"))
    outer = sizes.groupBy("part").agg(F.sum("tokens").alias("all"))
    outer = outer.select("part", (F.sum("all").over(Window.partitionBy().orderBy("part")) - F.col("all")).alias("outer"))
    starts = inner.join(outer, "part").select("part", "shard", (F.col("inner") + F.col("outer")).alias("start"))
    shards = files.select("part", "shard", "payload").mapInArrow(trimmed(_decode), "part int, shard int, doc_id long, before long, n_tokens long, ids_crc32 long")
    return shards.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(len(b)):
            shard = Shard(b.column(2)[k].as_py())
            crc = [(d, zlib.crc32(raw)) for d, raw in shard.documents()]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, b.column(0)[k].as_py()), pa.int32()), pa.array(np.full(n, b.column(1)[k].as_py()), pa.int32()),
                    pa.array([d for d, _ in crc], pa.int64()), pa.array(np.cumsum(shard.sizes) - shard.sizes, pa.int64()),
                    pa.array(shard.sizes, pa.int64()), pa.array([c for _, c in crc], pa.int64()),
                ],
                ["part", "shard", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the documents' ids to files and returns what reading them back gives, one row a document.

    A null or empty text is the end id alone. Rows that repeat a doc_id are separate documents, next to each other, in
    the order of a hash of their texts. Null doc_ids come first. An empty table writes files without shards and gives no
    rows. Other columns are ignored. Files go to `path`, or to a new folder of the shared directory.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
