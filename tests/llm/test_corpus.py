"""The corpus operators on small rows of our own: brute force, round trips, odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vitrine.llm import components, decontaminate, langid, line_dedup, mixing, near_dup, quality, secrets, simhash, token_output, topk, toxicity
from vitrine.llm.common import mix, text_chunks, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text2 string, fp long, size string"
WORDS = "the of and red blue green boats sail over water quickly while seven old foxes sleep under warm trees near rivers".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ly", "s", "ed"]) for _ in range(n))


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, "x", 1, "y") for i, t, l, s in rows], DOCS)


def odd_rows():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = [(k, prose(rng, 40), "en", f"s{k % 3}") for k in range(30)]
    return base + [(100, None, "en", "s1"), (101, "", None, None), (102, "   \n\t ", "de", "s2"), (103, long, "en", "s0"), (None, "no id here", "en", "s1"),
                   (104, base[3][1], "en", "s0"), (105, base[3][1], "en", "s0"), (5, base[5][1], "en", "s2"), (106, "ab\x1ccd é ß   x", "fr", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return corpus(spark, [])


def test_simhash_brute(docs, empty):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count() and simhash.simhash_components(empty).count() == 0
    rows = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got]
    up = {d: d for d, _, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [r for r in rows if r[0] is not None]
    for a, f, _ in known:
        for b, g, _ in known:
            if (f ^ g).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert all(c == root(d) for d, _, c in known)
    assert [c for d, _, c in rows if d is None] == [None]
    assert next(f for d, f, _ in rows if d == 100) == 0


def test_simhash_links_dense_group():
    rng = np.random.default_rng(1)
    key = (1 << 16 | 2)
    fp = np.unique(np.array([(int(x) & 0xFFFFFFFF) << 32 | 0x00020001 for x in rng.integers(0, 64, 60)], np.uint64))
    probe = np.zeros(len(fp), np.int32)
    out = simhash.links_of_key(key, fp, probe)
    assert len(out) < len(fp)
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 3 for a, b in out)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in got} and {x for e in edges if e[0] != e[1] for x in e} == set(got)


def test_mixing(docs, empty, spark):
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == docs.count()
    assert mixing.mix_sources(empty).count() == 0
    total = sum(r["size"] for r in rows)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert all(t <= 2 * s + 1e-9 for s, t in sources.values())
    for s, (size, target) in sources.items():
        mine = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in mine) == size
        assert abs(sum(r["taken"] for r in mine) - target) <= max([r["size"] for r in mine])
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)


def test_mixing_keeps_mass(spark):
    rng = random.Random(3)
    units = [((k, s), "a", float(s), rng.uniform(0.05, 0.95)) for k, s in ((k, rng.randrange(1, 400)) for k in range(700))]
    got = mixing.pivotal_rounding(spark.createDataFrame(units, "id struct<doc_id:bigint,size:bigint>, source string, a double, p double"), block=32).collect()
    assert len(got) == len(units) == len({r["id"]["doc_id"] for r in got})
    assert abs(sum(r["id"]["size"] * r["bit"] for r in got) - sum(a * p for _, _, a, p in units)) <= max(u[2] for u in units)


def test_token_round_trip(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(token_output.tokenizer_path())
    got = token_output.token_output(docs, path=str(tmp_path / "t")).collect()
    want = sorted(zlib.crc32(np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for _, t, _, _ in odd_rows())
    assert sorted(r["ids_crc32"] for r in got) == want
    rows = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:k]) for k in range(len(rows))]
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids) and rows[0]["doc_id"] is None
    assert token_output.token_output(empty, path=str(tmp_path / "e")).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(0)
    docs = [np.r_[rng.integers(5, 25, n), 2].astype(np.int64) for n in (0, 1, 300, 5000, 1, 7)]
    docs += [np.r_[np.full(1000, 7), 2], docs[3]]
    raw = token_output.encode_shard([None, *range(7)], np.array([len(d) for d in docs]), np.concatenate(docs), 49408)
    block = token_output.Shard(raw)
    assert all((block.document(k) == d).all() for k, d in enumerate(docs))
    assert [d for d, _ in block.documents()] == [None, *range(7)]
    assert len(raw) < 4 * sum(map(len, docs)) and len(block.rules) and (block.lengths >= 2).all()


def test_language(spark, empty):
    rng = random.Random(1)
    de = "der die und nicht eine mit schön über wasser fährt langsam".split()
    rows = [(k, " ".join(rng.choice(de if k % 2 else WORDS) for _ in range(30)), "de" if k % 2 else "en", "s") for k in range(300)]
    rows += [(900, None, "en", "s"), (901, "123 !!", "de", "s"), (902, "", None, "s"), (None, "the water and the foxes", "en", "s")]
    got = {r["doc_id"]: r for r in langid.identify_languages(corpus(spark, rows)).collect()}
    assert len(got) == len(rows) and langid.identify_languages(empty).count() == 0
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    held = [(i, l) for i, t, l, _ in rows if i is not None and i < 900 and got[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in held)
    assert sum(got[i]["lang_pred"] == l for i, l in held) >= 0.95 * len(held)
    none = langid.identify_languages(corpus(spark, [(1, "abc", None, "s")])).first()
    assert none["lang_pred"] == "und"


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    rows = [(k, prose(rng, 60) + "." if k % 3 else " | ".join(rng.choice(WORDS) for _ in range(50)), "en", "s") for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(240)] + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.fit_and_score(corpus(spark, rows), labels).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == int(k % 3 > 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.fit_and_score(docs, labels.where("false")).count() == docs.count()
    assert quality.fit_and_score(empty, labels).count() == 0
    assert quality.keep_good(corpus(spark, rows), labels).columns == docs.columns


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        w = prose(rng, 40).split()
        if k % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grumpf", "blarg"]))
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1, int(k % 5 == 0)))
    y = spark.createDataFrame(labels + [(3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(corpus(spark, rows), y).collect()}
    assert all(got[k]["predicted"] == int(k % 5 == 0) for k in got)
    s = got[0]["segments"][0]
    assert "grumpf" in rows[0][1][s["start"] : s["end"]] or "blarg" in rows[0][1][s["start"] : s["end"]]
    assert toxicity.score_toxicity(docs, y).count() == docs.count() and toxicity.score_toxicity(empty, y).count() == 0


def test_toxicity_witnesses(spark):
    """Different texts are witnesses each; copies are one, for each label."""
    rng = random.Random(4)
    rows = [(k, f"{prose(rng, 40)} {'grumpf blarg ' * (k % 5 == 0)}tail", "en", "s") for k in range(400)]
    y = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(corpus(spark, rows), y).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got)
    texts = spark.createDataFrame([(1, "One two"), (2, "one TWO"), (3, "one two"), (3, "one two"), (4, "two one"), (5, ""), (6, None)], "doc_id long, text string")
    y = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 1)], "doc_id long, toxic int")
    found = toxicity._labelled_texts(texts, y)
    got = sorted((r["text"].lower(), r["n0"], r["n1"], r["weight"]) for r in found.collect() if r["text"])
    assert got == [("one two", 1, 1, 1.0), ("two one", 1, 0, 1.0)]
    uses, seen = toxicity.use_counts(found)
    assert uses.sum(0)[:, toxicity.slots(words(next(text_chunks(pa.array(["two"]))), alnum=True, prefixes=(4,))[0])[0, 0]].tolist() == [2, 1]
    assert seen.sum(0).tolist() == [2, 3]  # the texts without words are witnesses of no word


def test_toxicity_weights_and_curves(spark):
    """Log-odds, the extreme-value fit and the combined evidence against their formulas."""
    n0, n1 = np.array([0.0, 9.0, 0.0]), np.array([0.0, 0.0, 5.0])
    w = toxicity.log_odds(n0, n1, 90, 10)
    want = [np.log((b + 1.0) / (a + 9.0)) - np.log(10 / 90) for a, b in zip(n0, n1)]
    assert np.allclose(w[:3], want, atol=1e-5) and w[3] == 0 and abs(w[0]) < 1e-6
    rng = np.random.default_rng(3)
    n = rng.integers(50, 2000, 6000)
    s = (np.log(0.02 * n) - np.log(-np.log(rng.uniform(size=6000)))) / 0.8
    lam, k = toxicity.fit_extremes(spark.createDataFrame([(float(a), int(b)) for a, b in zip(np.maximum(s, 0), n)], "s double, n long"))
    assert abs(lam - 0.8) < 0.08 and 0.01 < k < 0.04
    model = toxicity.ToxicModel(lam, k, -2.0, 0.5)
    rows = spark.createDataFrame([([], 10), ([1.5], 30), ([9.0, 2.0, 8.0, 0.1], 400)], "scores array<float>, n long")
    for r in toxicity._evidence(rows, rows["scores"], model).collect():
        assert r["evidence"] == pytest.approx(model.evidence(np.array(r["scores"], np.float32).astype(float), r["n"]), abs=1e-6)


def brute_segments(x):
    """All maximal scoring segments, by their recursive definition."""
    if not len(x) or max(x) <= 0:
        return []
    best = max(((sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), key=lambda r: (round(r[0], 9), r[1], -r[2]))
    _, _, a, b = best
    return brute_segments(x[:a]) + [(a, b)] + [(a2 + b, b2 + b) for a2, b2 in brute_segments(x[b:])]


def test_maximal_segments():
    rng = random.Random(6)
    for _ in range(150):
        x = [rng.choice([-3.1, -1.3, 0.9, 2.2, 1.7]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(x, float))] == brute_segments(x)


def edit(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        cur = [i + 1]
        for j, d in enumerate(t):
            cur.append(min(prev[j] + (c != d), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_decontamination(spark, docs, empty):
    rng = random.Random(8)
    items = [(k, prose(rng, 12)) for k in range(6)] + [(90, None), (91, ""), (92, "   ")]
    texts = []
    for k in range(40):
        t = prose(rng, 60)
        if k % 3 == 0:
            x = list(items[k % 6][1])
            for _ in range(rng.randrange(0, 7)):
                x[rng.randrange(len(x))] = rng.choice("abcxyz ")
            t = t[:100] + " " + "".join(x).upper() + "\n" + t[100:]
        texts.append((k, t, "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(corpus(spark, texts), bench).collect()}
    want = {}
    for d, t, _, _ in texts:
        for i, x in items:
            p = decontaminate.normalise(x)
            if p and (e := edit(p, decontaminate.normalise(t))) <= decontaminate.budget(p):
                want[d, i] = e
    assert got == want and want
    blocks = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(corpus(spark, texts), bench, block_bytes=200).collect()}
    assert blocks == want
    assert decontaminate.contaminated(docs, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_secrets(spark, docs, empty):
    rng = random.Random(9)
    bits = ["password: hunter2hunter2", "TOKEN='abc'", 'api_key = "AbCdEf123456"', "AKIA" + "A1" * 10, "0123456789abcdef" * 3, "deadbeef", "ghp_" + "a1B2" * 10, "é secret=ünï12345678"]
    rows = [(k, " ".join(rng.choice(bits + WORDS) for _ in range(30)), "en", "s") for k in range(60)] + [(70, None, "en", "s"), (71, "", "en", "s")]
    got = {r["doc_id"]: r for r in secrets.find_secrets(corpus(spark, rows)).collect()}
    for d, t, _, _ in rows:
        spans = []
        for i, r in enumerate(secrets.BASE):
            spans += [(m.start(), i, m.end(), r.kind) for m in re.finditer(r.regex, t or "") if len(m[r.group]) >= r.least]
        spans.sort()
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[d][f"n_{r.kind}"] for r in secrets.BASE] == [sum(s[3] == r.kind for s in spans) for r in secrets.BASE]
    assert any("github:" in r["spans"] for r in got.values())
    assert secrets.find_secrets(docs).count() == docs.count() and secrets.find_secrets(empty).count() == 0


def test_trigram_queries():
    q = secrets.trigram_query
    assert q(r"[0-9a-f]+") == [frozenset()]
    assert {frozenset({"abc", "bcd"})} == set(q("abcd+e?"))
    assert set(q("(?i:FOO|bar)[a-z]*")) == {frozenset({"foo"}), frozenset({"bar"})}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).round(1)
    x[50:80] = x[50]
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)] + [(400, None, 0), (450, [float("nan")] * 8, 0), (None, [1.0] * 8, 0), (451, [None] * 8, 0)]
    got = [tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()]
    v = np.floor(256 * np.array(x, np.float32).astype(float))
    want = []
    for q in range(0, 400, 50):
        s = v @ v[q]
        s[q] = -np.inf
        want += [(q, i + 1, int(d), int(s[d])) for i, d in enumerate(np.lexsort((np.arange(400), -s))[:5])]
    assert sorted(got) == want
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_shards_and_repeats(spark, monkeypatch):
    """Many shards, vectors of two lengths, repeated rows and ids, clashing columns; against all pairs."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(v) for v in rng.normal(size=6 if k % 7 else 3)]) for k in range(500)]
    rows += [rows[50]] * 60 + [rows[100], (100, rows[3][1]), (250, []), (300, [])]
    got = sorted(tuple(r) for r in topk.exact_top_k(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, shard int, x int")).collect())
    want = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        pairs = [
            (-int(np.floor(256 * np.array(x)) @ np.floor(256 * np.array(y))), j)
            for i, x in rows if i == q for j, y in rows if j != q and len(x) == len(y)]
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(pairs)[:5])]
    assert got == want


def test_line_dedup(spark, docs, empty):
    rng = random.Random(10)
    base = [prose(rng, 25) for _ in range(12)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(50)}"
            lines.append(" ".join(w))
        rows.append((k, "\n".join(lines + ["", "Tail"]), "en", "s"))
    got = {r["doc_id"]: (r["n_links"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_links(corpus(spark, rows)).collect()}
    flat = [(d, frozenset(x.lower().split())) for d, t, _, _ in rows for x in t.split("\n") if x.strip()]
    sets = list(dict.fromkeys(s for _, s in flat))
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    links = {s: sum(near(s, o) for o in sets if o != s) for s in sets}
    late = {s: any(near(s, o) for o in sets[:i]) for i, s in enumerate(sets)}
    want, seen = {d: [0, 0, 0] for d, _, _, _ in rows}, set()
    for d, s in flat:
        want[d][0] += links[s]
        want[d][1] += 1
        want[d][2] += s in seen or late[s]
        seen.add(s)
    assert got == {d: tuple(x) for d, x in want.items()}
    kept = line_dedup.dedup_lines(corpus(spark, rows))
    assert sum(len([x for x in r["text"].split("\n") if x.strip()]) for r in kept.collect()) == sum(x[1] - x[2] for x in want.values())
    out = line_dedup.line_links(docs).collect()
    assert len(out) == docs.select("doc_id", "text").distinct().count() and line_dedup.line_links(empty).count() == 0


def test_near_dedup_stage(spark, docs, empty):
    """The pipeline's stage against all pairs of five-word shingle sets; near copies differ in more than three bits."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 20, 120]))), "en", "s") for k in range(60)]
    for k in range(60, 160):
        w = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((k, " ".join(w), "en", "s"))
    rows += [(160, "", "en", "s"), (161, None, "en", "s"), (None, rows[0][1], "en", "s")]

    def grams(x):
        w = (x or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    sets = {d: grams(x) for d, x, _, _ in rows if d is not None}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    far = 0
    for a in sets:
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                far += (simhash.fingerprint(rows[a][1]) ^ simhash.fingerprint(rows[b][1])).bit_count() > 3
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    got = corpus_pipeline.near_dedup(spark, corpus(spark, rows), "")
    assert far and sorted(r["doc_id"] for r in got.collect()) == sorted({root(d) for d in sets})  # the copy with a null id goes
    assert corpus_pipeline.near_dedup(spark, empty, "").count() == 0 and corpus_pipeline.near_dedup(spark, docs, "").columns == docs.columns


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, now = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, sf)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        before, now = now, spark.read.parquet(str(tmp_path / str(k)))
        if k == 1:
            assert now.count() == near_dup.near_duplicates(before).select("component_id").distinct().count()
        if k == 2:
            bad = {r["doc_id"] for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in before.collect()} - bad
    assert corpus_pipeline.run(spark, sf).count() == now.count()
