import math
import time

import numpy as np
import pytest

from keelson.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, n int, unit int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "a", "b", 1, 2) for i, e in rows], SCHEMA)


def sample(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[rng.integers(0, n // 4, n - n // 2)] + rng.normal(0, 0.12, (n - n // 2, d))
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(x)]


ODD = [(2000, None), (2050, [1.0, None] + [0.0] * 14), (2100, [float("nan")] * 16), (2150, [0.0] * 16), (2200, [float("inf")] + [0.0] * 15)]


def top_brute(rows, every, k):
    rows = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    for q, w in {i: e for i, e in sorted(rows, reverse=True) if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(w, e, strict=True)), i) for i, e in rows if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [8192, 37])
def test_top_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = sample(150) + ODD + [(500 + i, sample(8)[0][1]) for i in range(12)]
    got = topk.top_inner_products(frame(spark, rows), every=50).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == top_brute(rows, 50, 5)


def test_top_few_and_none(spark):
    rows = [(0, [0.5, -1.0]), (1, [0.5, -1.0]), (None, [9.0, 9.0])]
    got = topk.top_inner_products(frame(spark, rows)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)]
    assert topk.top_inner_products(frame(spark, [])).collect() == []


def test_large_components_and_unequal_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e8, 1.0]), (2, [3.0, 4.0]), (3, [1.0, 2.0, 3.0]), (50, [5.0, 6.0, 7.0]), (100, [1.0]), (4, [1e30, -1e30])]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner_products(frame(spark, rows)).collect()}
    # 1e30 stops at 2**62: 256 * 2**62 - 512 * 2**62 is below a long's range.
    large = 256 * 25_600_000_000 + 512 * 256
    assert got == {(0, 1, 1, large), (0, 2, 2, 256 * 256 * 11), (0, 3, 4, -(2**63)), (50, 1, 3, 256 * 256 * 38)}


def test_bit_slices_sum_exactly():
    rng = np.random.default_rng(4)
    x, w = rng.integers(-300, 300, (130, 9)), rng.integers(-300, 300, 9)
    bits, low = topk.slices(x)
    ids = np.arange(130) * 3
    got_ids, got = topk.block_top(bits, low, ids, w, -1, 7)
    want = sorted(zip((-(x @ w)).tolist(), ids.tolist(), strict=True))[:7]
    assert list(zip((-got).tolist(), got_ids.tolist(), strict=True)) == want


def link_brute(rows, cosine):
    ok = {}
    for k, (_, e) in enumerate(rows):
        if e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e, dtype=np.float64)
            ok[k] = v / math.sqrt(float(v @ v))
    n = [0] * len(rows)
    groups = list(range(len(rows)))

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                n[a] += 1
                n[b] += 1
                groups[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((repr(i), n[k], None if i is None else least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("unit", [2048, 23])
def test_links_and_components(spark, monkeypatch, unit):
    monkeypatch.setattr(vectors, "UNIT", unit)
    rows = sample(160, seed=2)
    rows += ODD + [(300 + i, rows[5][1]) for i in range(6)] + [(400, [2 * x for x in rows[5][1]]), (401, [-x for x in rows[5][1]]), (None, rows[5][1])]
    got = vectors.similar_vectors(frame(spark, rows), cosine=0.9).collect()
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got) == link_brute(rows, 0.9)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("unit, meetings", [(2048, 1 << 20), (7, 5)])
def test_vectors_of_unequal_length(spark, monkeypatch, unit, meetings):
    """Lengths that average to another one, a length of a single row, and more units than are looked at at once."""
    monkeypatch.setattr(vectors, "UNIT", unit)
    monkeypatch.setattr(vectors, "MEETINGS", meetings)
    rng = np.random.default_rng(4)
    rows = []
    for length in (2, 3, 4, 5):
        for _ in range(30):
            x = rng.normal(size=length)
            rows += [(len(rows), x.tolist()), (len(rows) + 1, (x + rng.normal(size=length) * 0.1).tolist())]
    rows += [(len(rows), [1.0]), (len(rows) + 1, [3.0] * 7), *ODD]
    got = vectors.similar_vectors(frame(spark, rows), cosine=0.9).collect()
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got) == link_brute(rows, 0.9)


def test_shuffled_bytes_grow_with_the_table(spark, monkeypatch):
    """Vectors without clusters, each of which has to meet all units: they go there without being shuffled."""
    monkeypatch.setattr(vectors, "UNIT", 16)
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def shuffled(n):
        table = frame(spark, [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(n).normal(size=(n, 64)))])
        marks = []
        for run in (lambda: None, lambda: vectors.similar_vectors(table).collect()):
            run()
            time.sleep(0.5)
            spark.range(2).collect()  # its tasks bring the totals up to date
            bus.waitUntilEmpty()
            marks.append(store.executorList(True).head().totalShuffleWrite())
        return marks[1] - marks[0]

    assert 0 < shuffled(800) < 8 * shuffled(200)


@pytest.mark.parametrize("unit", [2048, 40])
def test_dense_links(spark, monkeypatch, unit):
    """Many links, most of them within trees that others have joined; two groups that one vector joins."""
    monkeypatch.setattr(vectors, "UNIT", unit)
    rng = np.random.default_rng(6)
    a, b = np.eye(8)[0], np.eye(8)[0] * math.cos(0.8) + np.eye(8)[1] * math.sin(0.8)
    x = [*(a + rng.normal(0, 0.02, (150, 8))), *(b + rng.normal(0, 0.02, (150, 8))), a + b, *rng.normal(size=(60, 8))]
    rows = [(1000 - i, v.tolist()) for i, v in enumerate(x)]
    got = vectors.similar_vectors(frame(spark, rows)).collect()
    assert sorted((repr(r.vec_id), r.n_links, r.component_id) for r in got) == link_brute([(i, np.float32(v).tolist()) for i, v in rows], 0.9)
    assert max(r.n_links for r in got) > 290


def test_no_vectors(spark):
    assert vectors.similar_vectors(frame(spark, [])).collect() == []
    got = vectors.similar_vectors(frame(spark, ODD)).collect()
    assert {(r.n_links, r.kept) for r in got} == {(0, True)} and len(got) == len(ODD)
