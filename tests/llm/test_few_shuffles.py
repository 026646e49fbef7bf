"""Steps of near-duplicate detection that took many small shuffles, or one with many rows, against brute force."""

import random

import numpy as np
import pyarrow as pa

from vitrine.llm import components, simhash


def _linked(nodes, near):
    """node -> least node that pairs for which near(x, y) holds reach."""
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in nodes:
        for y in nodes:
            if x < y and near(x, y) and root(x) != root(y):
                up[max(root(x), root(y))] = min(root(x), root(y))
    return {x: root(x) for x in nodes}


def test_few_links_take_few_jobs(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(-40, 40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(5, 5), (-7, None)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    spark.sparkContext.setJobGroup("few links", "")
    got = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    pairs = {(min(e), max(e)) for e in edges if None not in e and e[0] != e[1]}
    assert got == _linked(sorted({x for e in pairs for x in e}), lambda x, y: (x, y) in pairs)
    assert jobs <= 12
    monkeypatch.setattr(components, "FEW", 0)
    assert got == {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert components.connected_components(df.where("false")).count() == 0


def test_four_rows_a_fingerprint(spark, monkeypatch):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << bit
        prints.append(x)
    signed = sorted(set(np.array(prints, np.uint64).view(np.int64).tolist()))
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(signed)], "doc_id long, fp long").repartition(3)
    assert simhash._keys(docs.select("fp", docs["fp"].alias("node"))).count() == 4 * len(signed)
    got = {r["fp"]: r["component_id"] for r in simhash.near_duplicate_components(docs).collect()}
    near = lambda i, j: ((signed[i] ^ signed[j]) & (1 << 64) - 1).bit_count() <= 3
    assert got == {signed[k]: c for k, c in _linked(range(len(signed)), near).items()}
    rows = sorted((r["key"], r["fp"]) for r in simhash._keys(docs).collect())
    for held in (1, 16, 1 << 16):  # keys that go on in the next batch
        monkeypatch.setattr(simhash, "_HELD", held)
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in some], "fp": [x for _, x in some]}) for some in (rows[a : a + 7] for a in range(0, len(rows), 7))]
        pairs = {(min(u, v), max(u, v)) for b in simhash._linked_rows(iter(batches), 3) for u, v in zip(*(c.to_pylist() for c in b.columns))}
        least = _linked(signed, lambda x, y: (x, y) in pairs)
        assert least == _linked(signed, lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count() <= 3)
