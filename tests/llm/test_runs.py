import random

import numpy as np
import pytest

from keelson.llm import queries, runs

from .conftest import WORD, sentence


def brute(words):
    """Every period is tried: stretches of words that are equal ``q`` apart."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(rng):
    k, n = rng.choice([1, 2, 3, 10]), rng.choice([0, 1, 5, 8, 20, 60, 200])
    x = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
        x = [x[i if i < a else a + (i - a) % p] for i in range(n)]
    return x


@pytest.mark.parametrize("seed", range(4))
def test_find_runs_equals_all_periods(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(runs, "LEAVES", 7)
    for _ in range(200):
        texts = [random_words(rng) for _ in range(rng.randint(1, 5))]
        got = runs.find_runs(np.array(sum(texts, []), dtype=np.int64), np.array([len(x) for x in texts]))
        assert [tuple(r) for r in got.tolist()] == [(d, *r) for d, x in enumerate(texts) for r in brute(x)]


def test_suffix_array_is_sorted():
    rng = random.Random(5)
    x = [rng.randrange(3) for _ in range(300)]
    s = runs._with_ends(np.array(x), np.array([100, 200]))
    order, rank = runs.suffix_array(s)
    tails = [s[i:].tolist() for i in range(len(s))]
    assert order.tolist() == sorted(range(len(s)), key=tails.__getitem__)
    assert rank[order].tolist() == list(range(len(s)))
    shared = [0] + [next(k for k in range(400) if tails[a][k] != tails[b][k]) for a, b in zip(order[:-1], order[1:], strict=True)]
    assert runs.common_prefixes(s, order).tolist() == shared


@pytest.mark.parametrize("words, want", [
    ([0] * 100_000, [(0, 100_000, 1)]),
    ([0, 1] * 50_000 + [2], [(0, 100_000, 2)]),
    ([0] * 30_000 + [1] + [0] * 30_000, [(0, 30_000, 1), (30_001, 30_000, 1)]),
    (list(range(1000)) * 60, [(0, 60_000, 1000)]),
    (list(range(1000)) * 3, []),
])
def test_long_runs(words, want):
    got = runs.find_runs(np.array(words), np.array([len(words)]))
    assert [tuple(r[1:]) for r in got.tolist()] == want


def test_rows(spark, docs):
    """Null, empty and very long texts, repeated rows, null ids, foreign columns, white space of all kinds."""
    rng = random.Random(3)
    long = " ".join([f"w{rng.randrange(5000)}" for _ in range(40_000)] + ["la", "la", "lü"] * 2000 + ["x"])
    texts = [(1, "a\tb a b\na b a  b a b"), (2, None), (3, ""), (4, " \n"), (5, "x x x x x x y y y y y y"), (None, "la " * 6), (5, "x x x x x x y y y y y y"), (6, long), (7, "la la la la la")]
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs(texts)).collect()}
    for i, t in texts:
        words = WORD.findall(t or "")
        found = [(40_000, 6000, 3)] if i == 6 else brute(words)
        assert got[i, len(words)] == (found, collapsed(words, found))
    assert runs.periodic_runs(docs(texts)).count() == len(texts)
    assert runs.periodic_runs(docs([])).count() == 0


def test_query_rewrites_a_tenth(spark, docs):
    import zlib

    texts = [(i, " ".join(sentence(i, 30 + i))) for i in range(60)] + [(None, "a b"), (100, None), (101, "")]
    got = {r.doc_id: r.text for r in queries.with_periods(docs(texts)).collect()}
    hit = 0
    for i, t in texts:
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and t:
            w, g = t.split(), h // 10
            n = len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t, hit = " ".join(w[k if k < a else a + (k - a) % p] for k in range(n)), hit + 1
        assert got[i] == t
    assert hit
