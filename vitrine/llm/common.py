"""Shared pieces of the corpus operators: shared scratch space, batch limits, byte-level text arrays."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels take at a time; bounds a Python worker's memory whatever the batch holds.
CHUNK_BYTES = 1 << 21
#: Rows and bytes an Arrow batch holds at most, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in spark.checkpoint.dir.

    Where it names none, one is set beside the warehouse, which a cluster shares too; never a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the session's Arrow batches by rows and bytes, where a user has not set smaller ones, and makes sure that
    checkpoints have a place."""
    for name, limit in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        set_ = spark.conf.get(key, None)
        size = int(set_) if set_ and set_.isdigit() else 0
        if not 0 < size <= limit:
            spark.conf.set(key, str(limit))
    shared_dir(spark)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder. Spark removes the files with the last reference if
    the session sets spark.cleaner.referenceTracking.cleanCheckpoints; else they stay until the folder is cleared."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more: it does so only when the
    driver collects its garbage, which a driver with memory to spare rarely does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns by position of first appearance, so that extra columns and clashing names do no harm."""
    seen: dict[str, int] = {}
    for k, c in enumerate(df.columns):
        seen.setdefault(c, k)
    if len(seen) < len(df.columns):
        df = df.toDF(*[c if seen[c] == k else f"__{k}_{c}" for k, c in enumerate(df.columns)])
    return df.select(*[F.col(f"`{c}`") for c in columns])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under column names that clash with nothing, and the new name of each old one's first appearance."""
    names = [f"column {k}" for k in range(len(df.columns))]
    first: dict[str, str] = {}
    for old, new in zip(df.columns, names):
        first.setdefault(old, f"`{new}`")
    return df.toDF(*names), first


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """`numbered` undone: the columns of `like`, in its order and under its names."""
    return df.select(*[F.col(f"`column {k}`") for k in range(len(like.columns))]).toDF(*like.columns)


def trim() -> None:
    """Gives this worker's free memory back; else a reused worker keeps what its largest task held."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if release:
        release(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, and its memory given back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def keep_texts(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text `keep` finds good: one pass, without a join."""
    prepare(docs.sparkSession)
    plain, at = numbered(docs)
    k = plain.columns.index(at["text"].strip("`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b.column(k)), pa.bool_()))

    return restored(plain.mapInArrow(trimmed(run), plain.schema), docs)


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


# ---- byte-level text -------------------------------------------------------------------------------------------


class Texts:
    """A run of documents as one byte array: `data`, with document k at data[start[k]:start[k + 1]]."""

    def __init__(self, data: np.ndarray, start: np.ndarray, first: int):
        self.data, self.start, self.first, self.n = data, start, first, len(start) - 1


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole documents in runs of about `limit` bytes; a longer document is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, values = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def pieces(t: Texts, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """A document longer than `limit` in pieces that end at ASCII white space, so that no word is cut; others as they are."""
    if t.n != 1 or len(t.data) <= limit:
        yield t
        return
    at = 0
    while at < len(t.data):
        end = min(at + limit, len(t.data))
        if end < len(t.data):
            gaps = np.flatnonzero(SPACE[t.data[at:end]])
            while not len(gaps) and end < len(t.data):  # one word of more than `limit` bytes stays whole
                start, end = end, min(end + limit, len(t.data))
                gaps = np.flatnonzero(SPACE[t.data[start:end]]) + (start - at)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
        yield Texts(t.data[at:end], np.array([0, end - at]), t.first)
        at = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def by_byte(data: np.ndarray, table: bytes) -> np.ndarray:
    """table[x] of every byte x; several times as fast as an index."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


_AS_IT_IS = np.arange(256, dtype=np.uint8)
LOWER = _AS_IT_IS.copy()
LOWER[65:91] += 32
LOWER = LOWER.tobytes()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(t: Texts, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; runs end at document borders."""
    w = by_byte(t.data, is_word.tobytes()).view(bool)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, stop = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    stop[:-1] &= ~w[1:]
    inner = t.start[1:-1]
    inner = inner[(inner > 0) & (inner < len(w))]
    begin[inner] = w[inner]
    stop[inner - 1] = w[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def between(a: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many borders each of the places `a` has reached; both ascend."""
    return np.repeat(np.arange(len(borders) + 1), np.diff(np.r_[0, np.searchsorted(a, borders), len(a)]))


def hash_order(h: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit hashes. Their high bits are sorted with the places in the low ones, which is faster than
    argsort; hashes that need their low bits to be told apart are rare."""
    low = np.uint64(len(h).bit_length())
    x = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    x.sort()
    order = (x & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    found = h[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(h, kind="stable")


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Spans longer than this are hashed one by one.
_LONG = 4096


class Spans:
    """Hashes of runs of bytes, eight bytes at a time; those of at most eight bytes differ if the runs do."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, "<u8", self.data, strides=(1,))

    def hashes(self, a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
        n = (b - a).astype(np.uint64)
        salt = np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64))
        h = mix(self._block(a, n) * _ODD + mix(n + salt))
        rest, at = np.flatnonzero((n > 8) & (n <= _LONG)), 8
        while len(rest):
            h[rest] = mix((h[rest] ^ self._block(a[rest] + at, n[rest] - np.uint64(at))) * _ODD + salt)
            at += 8
            rest = rest[n[rest] > at]
        if (n > _LONG).any():
            import xxhash

            for k in np.flatnonzero(n > _LONG).tolist():
                h[k] = xxhash.xxh64_intdigest(self.data[a[k] : b[k]].tobytes(), seed)
        return h

    def tails(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The last eight bytes of runs of more than eight, else 0."""
        return np.where(b - a > 8, self.eight[np.maximum(b - 8, 0)], np.uint64(0))

    def _block(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first eight of n bytes from a on, or all n of them, as a number."""
        x = self.eight[a]
        short = np.flatnonzero(n < 8)
        x[short] &= (np.uint64(1) << (n[short] << np.uint64(3))) - np.uint64(1)
        return x


def words(
    t: Texts, lower: bool = True, alnum: bool = False, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start, end and document of every word, in order.

    Words are runs of non-space bytes, or of letters, digits and non-ASCII bytes with alnum=True. With `prefixes` the
    first result is (words, 1 + prefixes): next to each word's hash those of its first bytes, 0 where it has no more."""
    a, b = word_spans(t, _WORD if alnum else ~SPACE)
    doc = between(a, t.start[1:-1])
    if not len(a):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), a, b, doc
    spans = Spans(by_byte(t.data, LOWER) if lower else t.data)
    h = spans.hashes(a, b)
    if prefixes:
        cols = [h]
        for k in prefixes:
            part = np.zeros(len(a), np.uint64)
            long = np.flatnonzero(b - a > k)
            part[long] = spans.hashes(a[long], a[long] + k, seed=1)
            cols.append(part)
        h = np.stack(cols, 1)
    return h, a, b, doc
