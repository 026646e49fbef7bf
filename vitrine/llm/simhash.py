"""SimHash near-duplicate detection with a pigeonring filter.

A fingerprint is cut into a ring of four 16-bit segments. If two fingerprints differ in at most tau = 3 bits, then from
some segment on, every chain of l consecutive segments differs in at most floor(l * tau / 4) bits: 0, then 1, then 2,
then 3 (the strong form of the pigeonhole principle on a ring). So a pair is a candidate only where one segment agrees
and the next one differs in at most one bit. A row for each segment travels; where segments agree, the index holds each
value of the successor, probes flip one bit of it, and the longer chains are checked before the full distance.

Equal fingerprints are one node. Within a key, links are reduced to a spanning forest before they leave the task, so a
large group of near copies gives as many rows as it has members, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, numbered, only, prepare, restored, trimmed
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_SEGMENTS, _WIDTH = 4, 16
#: Rows of a key above which candidates are looked up by the third segment instead of compared one by one; the links
#: span the same components either way.
_DENSE = 2048
#: Rows of whole segment values that are grouped at a time.
_HELD = 1 << 16
#: Shingle hashes counted at a time.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 for a text without words."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone are lowered, only ASCII space splits
    if not w:
        return 0
    joined = b" ".join(w)
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    k = shingle_words
    if len(w) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        h = np.array(hashes[at : at + _BLOCK], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row for each document, fp a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x, shingle_words, seed) for x in b.column(1).to_pylist()), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    prepare(docs.sparkSession)
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        trimmed(run), "doc_id long, fp long"
    )


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): four rows for each fingerprint, keyed by a segment's number and value."""
    fp = F.col("fp")
    seg = lambda i: F.shiftrightunsigned(fp, _WIDTH * i).bitwiseAND(F.lit((1 << _WIDTH) - 1))
    return nodes.select(F.explode(F.array(*[seg(i).bitwiseOR(F.lit(i << _WIDTH)) for i in range(_SEGMENTS)])).alias("key"), "fp")


class _Forest:
    """Union-find over the rows of one key."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


_FLIPS = np.array(
    [0, *(1 << a for a in range(16)), *((1 << a) | (1 << b) for a in range(16) for b in range(a))], np.uint64
)


def links_of_key(key: int, fp: np.ndarray, probe: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Index pairs (into the rows of one key) that span the same components as all pairs within max_bits.

    probe 0 marks index rows. Each is compared with every row by the chain of the first three segments, then in full."""
    index = np.flatnonzero(probe == 0)
    if not len(index) or len(fp) < 2:
        return []
    i = key >> (2 * _WIDTH)
    third = np.uint64(_WIDTH * ((i + 2) % _SEGMENTS))
    mask = np.uint64((1 << _WIDTH) - 1)
    seg = (fp >> third) & mask
    used = probe.astype(np.int64)  # bits spent on the second segment
    forest, out = _Forest(len(fp)), []

    def check(x: int, others: np.ndarray) -> None:
        chain = np.bitwise_count(seg[others] ^ seg[x]).astype(np.int64) + used[x]
        others = others[chain <= (3 * max_bits) // _SEGMENTS]
        near = others[np.bitwise_count(fp[others] ^ fp[x]) <= max_bits]
        for y in near.tolist():
            if x != y and forest.join(x, y):
                out.append((x, y))

    if len(index) <= _DENSE:
        for x in range(len(fp)):
            check(x, index)
    else:
        order = index[np.argsort(seg[index], kind="stable")]
        values = seg[order]
        for x in range(len(fp)):
            want = seg[x] ^ _FLIPS
            lo, hi = np.searchsorted(values, want, "left"), np.searchsorted(values, want, "right")
            hit = np.flatnonzero(hi > lo)
            check(x, np.concatenate([order[lo[k] : hi[k]] for k in hit.tolist()]) if len(hit) else order[:0])
    return out


def _ring_groups(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows with the same segment -> (key, row numbers, probe) for each value of it and its successor.

    Index rows have that value; probes differ from it in one bit of the successor. Of two values that probe each other
    the lesser one has the pairs of both."""
    following = (key >> _WIDTH) + 1
    shift = (_WIDTH * (following % _SEGMENTS)).astype(np.uint64)
    pair = key << _WIDTH | ((fp.view(np.uint64) >> shift) & np.uint64((1 << _WIDTH) - 1)).astype(np.int64)
    order = np.argsort(pair, kind="stable")
    value, start, size = np.unique(pair[order], return_index=True, return_counts=True)
    near: dict[int, list[int]] = {k: [] for k in np.flatnonzero(size > 1).tolist()}
    for bit in range(_WIDTH):
        mine = np.flatnonzero(value & (1 << bit) == 0)
        want = value[mine] | (1 << bit)
        at = np.minimum(np.searchsorted(value, want), len(value) - 1)
        hit = value[at] == want
        for a, b in zip(mine[hit].tolist(), at[hit].tolist()):
            near.setdefault(a, []).append(b)
    rows = lambda k: order[start[k] : start[k] + size[k]]
    for k, others in near.items():
        found = np.concatenate([rows(k), *map(rows, others)])
        yield int(value[k]), found, np.r_[np.zeros(size[k], np.int64), np.ones(len(found) - size[k], np.int64)]


def _linked_rows(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """(key, fp) in order of key -> (u, v): fingerprints that link."""
    rest: list[np.ndarray] = []
    held, limit = 0, _HELD

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u, v = [], []
        for pair, rows, probe in _ring_groups(key, fp):
            for x, y in links_of_key(pair, fp[rows].view(np.uint64), probe, max_bits):
                u.append(fp[rows[x]])
                v.append(fp[rows[y]])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        rest.append(np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2)]))
        held += len(b)
        if held >= limit:
            cols = np.concatenate(rest, 1)
            last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last key may go on in the next batch
            if last:
                yield edges(*cols[:, :last])
            rest, held = [cols[:, last:].copy()], cols.shape[1] - last
            limit = max(_HELD, 2 * held)
    if held:
        yield edges(*np.concatenate(rest, 1))


def _links(keys: DataFrame, max_bits: int) -> DataFrame:
    spread = keys.repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(trimmed(lambda batches: _linked_rows(batches, max_bits)), "u long, v long")


def near_duplicate_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp) -> (fp, component_id) for every fingerprint of a row with a doc_id."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the four-segment ring holds for at most 3 differing bits")
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = connected_components(_links(_keys(nodes), max_bits))
    linked = cut(nodes.join(comp, nodes["fp"] == comp["node"]).select("fp", "least", "component"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    found = linked.join(least, "component").select("fp", "component_id")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def simhash_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Documents (doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id.

    One row for each input row. Texts are taken whole; A-Z are lowered, words are runs of anything but ASCII space, and
    shingles count as often as they occur. A null or empty text has fingerprint 0 and links like any other. A row whose
    doc_id is null keeps its fingerprint, links nothing and has a null component_id. Rows that repeat a doc_id are each
    returned; they share a component only if their fingerprints link. An empty table gives an empty result; other
    columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle_words))
    each = near_duplicate_components(prints, max_bits)
    return prints.join(each, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without near duplicates, with all their columns: of each component, the row with the least
    (doc_id, fingerprint) stays; of rows that agree in both, one. Rows with a null doc_id link nothing and stay."""
    prints = cut(fingerprints(docs, shingle_words))
    each = near_duplicate_components(prints, max_bits)
    first = prints.where("doc_id is not null").join(each, "fp").groupBy("component_id").agg(F.min(F.struct("doc_id", "fp")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("d"), F.col("first.fp").alias("f"))
    plain, at = numbered(docs)
    k = [plain.columns.index(at[c].strip("`")) for c in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle_words) for x in b.column(k[1])), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], [*b.schema.names, "fp"])

    with_fp = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("fp", LongType())]))
    kept = with_fp.join(first, (F.col(at["doc_id"]).cast("long") == F.col("d")) & (F.col("fp") == F.col("f"))).dropDuplicates(["d", "f"])
    return restored(kept.select(*plain.columns).unionByName(plain.where(F.col(at["doc_id"]).isNull())), docs)
