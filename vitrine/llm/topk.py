"""Exact top-k inner-product search by ball-tree branch and bound in every shard.

Candidates are dealt by hash to shards of bounded size; each shard builds a ball tree (split at the median of the widest
direction; a ball's inner products with q are at most q.c + |q| r). A first pass takes each query through one shard, its
home, and shares the k-th score found there; every other shard builds its tree once, has all queries streamed to it,
starts each from that bound, visits nodes by falling upper bound and stops as soon as no node can reach the query's k-th
score. So vectors are shuffled once, however many queries there are. Ties go to the smaller id, so a node whose bound
equals the k-th score is still searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, prepare

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Vectors that a shard holds on average; bounds a task's memory.
SHARD_ROWS = 8192
LEAF = 64


class BallTree:
    """Nodes as arrays; leaves hold runs of the permuted vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(x))
        self.center, self.radius, self.left, self.right, self.span = [], [], [], [], []
        todo = [(0, len(x), -1, False)]
        while todo:
            a, b, parent, is_right = todo.pop()
            me, part = len(self.center), x[order[a:b]]
            c = part.mean(0)
            self.center.append(c)
            self.radius.append(float(np.sqrt(((part - c) ** 2).sum(1).max())))
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((a, b))
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = me
            if b - a > leaf and self.radius[-1] > 0:
                axis = part[np.argmax(((part - c) ** 2).sum(1))] - c
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part @ axis, mid)]
                todo += [(a, a + mid, me, False), (a + mid, b, me, True)]
        self.ids, self.x = ids[order], x[order]
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.left, self.right = np.array(self.left), np.array(self.right)

    def search(self, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(scores, ids) of at most k best candidates of each query with a score of at least its floor, best first."""
        norm = np.sqrt((q * q).sum(1))
        # Upper bounds of all nodes at once; a hair above, so that rounding never hides a tie.
        upper = q @ self.center.T + norm[:, None] * self.radius[None, :]
        upper += 1e-9 * (1 + np.abs(upper))
        out = []
        for i in range(len(q)):
            bound, kth = upper[i], float(floor[i])
            scores, ids = np.zeros(0), np.zeros(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap:
                u, node = _pop(heap)
                if -u < kth:
                    break
                if self.left[node] >= 0:
                    for child in (self.left[node], self.right[node]):
                        if bound[child] >= kth:
                            _push(heap, (-bound[child], child))
                    continue
                a, b = self.span[node]
                s, d = self.x[a:b] @ q[i], self.ids[a:b]
                good = (s >= kth) & (d != query_ids[i])
                if not good.any():
                    continue
                scores, ids = np.concatenate([scores, s[good]]), np.concatenate([ids, d[good]])
                if len(scores) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    kth = max(kth, float(scores.min()))
            best = np.lexsort((ids, -scores))[:k]
            out.append((scores[best], ids[best]))
        return out


def _pop(heap):
    import heapq

    return heapq.heappop(heap)


def _push(heap, item):
    import heapq

    heapq.heappush(heap, item)


_HITS = "query_id long, vec_id long, score double"
_ROW = "shard int, query boolean, id long, x array<double>, floor double"


def _by_length(ids: pa.Array, x: pa.Array, *more: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Ids, vectors as a matrix and further columns, for each length of vectors."""
    size = np.diff(np.asarray(x.offsets))
    flat, start = np.asarray(x.values, float), np.asarray(x.offsets)[:-1]
    for d in np.unique(size).tolist():
        k = np.flatnonzero(size == d)
        yield (np.asarray(ids)[k], flat[start[k][:, None] + np.arange(d)], *(np.asarray(c)[k] for c in more))


def _trees(ids: pa.Array, x: pa.Array) -> dict[int, BallTree]:
    return {m.shape[1]: BallTree(i, m) for i, m in _by_length(ids, x)}


def _hits(trees: dict[int, BallTree], ids: pa.Array, x: pa.Array, floor: pa.Array, k: int) -> pa.RecordBatch:
    """The best candidates of each query; vectors of another length have no product."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for qid, q, low in _by_length(ids, x, floor):
        if (tree := trees.get(q.shape[1])) is not None:
            parts += [(np.full(len(d), i), d, s) for i, (s, d) in zip(qid, tree.search(qid, q, low, k))]
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def _search(k: int):
    """Rows of _ROW sorted by shard, candidates before queries: one tree a shard, to which its queries stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, trees = None, [], {}
        for b in batches:
            shard, query = np.asarray(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (query[1:] != query[:-1])])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)]):
                part = b.slice(lo, hi - lo)
                if shard[lo] != now:
                    now, held, trees = shard[lo], [], {}
                if not query[lo]:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    trees, held = _trees(whole.column("id").chunk(0), whole.column("x").chunk(0)), []
                yield _hits(trees, part.column(2), pa.concat_arrays([part.column(3)]), part.column(4), k)

    return run


def exact_top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """Vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: each query's k best by inner product.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by query_every, candidates every
    row but those with the query's own id. Vectors that are null or hold null or non-finite components, and rows with a
    null id, take no part; neither do pairs of different length. Rows that repeat an id are one candidate each, and the
    queries among them share one list of the k best pairs. Empty vectors score 0. Empty tables give an empty result.
    """
    spark = prepare(vectors.sparkSession)
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    fine = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = only(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null").where(fine)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), x.alias("x"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    # Rows that repeat in full are spread like others; the checkpoint makes the deal final.
    dealt = cut(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")))
    queries = dealt.where(F.col("id") % query_every == 0).select("id", "x")
    # The first shard is every query's home: about SHARD_ROWS vectors, which all executors get.
    home = dealt.where("shard = 0").select("id", "x").toArrow()
    trees = spark.sparkContext.broadcast(_trees(home.column("id").combine_chunks(), home.column("x").combine_chunks()) if len(home) else {})

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _hits(trees.value, b.column(0), b.column(1), pa.array(np.full(len(b), -np.inf)), k)

    first = cut(queries.mapInArrow(at_home, _HITS))
    if shards > 1:
        full = first.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        floor = F.when(F.col("n") >= k, F.element_at("s", k)).otherwise(F.lit(float("-inf")))
        asked = queries.join(full, F.col("id") == F.col("query_id"), "left").select("id", "x", floor.alias("floor"))
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards - 1))))
        both = dealt.where("shard > 0").select("shard", F.lit(False).alias("query"), "id", "x", F.lit(0.0).alias("floor")).unionByName(
            asked.select("shard", F.lit(True).alias("query"), "id", "x", "floor"))
        met = both.repartition("shard").sortWithinPartitions("shard", "query")
        first = first.unionByName(met.mapInArrow(_search(k), _HITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.col("score").cast("long").alias("score")
    )


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
