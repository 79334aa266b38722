import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import minhash
from keelson.llm.graph import components
from keelson.llm.words import Words, windows

from .conftest import WORD, sentence


def shingle_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    ids = [i for i, _ in rows if i is not None]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t, k)) for i, t in rows if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1c\xa0é漢", max_size=30), min_size=1, max_size=5))
def test_words_are_those_of_the_pattern(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    w = Words(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    found = [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert found == [x for t in texts for x in WORD.findall(t)]
    assert w.count.tolist() == [len(WORD.findall(t)) for t in texts]
    h = w.hashes()
    assert len({(x, y) for x, y in zip(found, h.tolist(), strict=True)}) == len(set(found)) == len(set(h.tolist()))


def test_long_texts_hash_in_segments(monkeypatch):
    from keelson.llm import words

    data = np.frombuffer(b" ".join(b"word%d" % (i % 37) for i in range(500)), dtype=np.uint8)
    whole = Words(data, np.array([0, len(data)])).hashes()
    monkeypatch.setattr(words, "SEGMENT_BYTES", 50)
    assert (Words(data, np.array([0, len(data)])).hashes() == whole).all()


def test_windows_depend_on_content_only():
    h = np.arange(100, dtype=np.uint64) % np.uint64(10)
    w = windows(h, 10)
    assert len(set(w[::10].tolist())) == 1 and len(set(w[:10].tolist())) == 10


def test_registers_estimate_and_merge():
    a, b = np.arange(1000, dtype=np.uint64) * np.uint64(77777777777), np.arange(200, 1200, dtype=np.uint64) * np.uint64(77777777777)
    from keelson.llm.words import mix

    a, b = mix(a), mix(b)
    both = np.union1d(a, b)
    r = minhash.registers(np.concatenate([a, b, both]), np.array([0, 1000, 2000, 2000 + len(both)]))
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    assert abs((r[0] == r[1]).mean() - 800 / 1200) < 0.15
    n = np.array([1000])
    assert minhash.plausible(r[:1], r[1:2], n, n, 0.65)[0] and not minhash.plausible(r[:1], r[1:2], n, n, 0.95)[0]
    one = minhash.registers(mix(np.arange(1, dtype=np.uint64)), np.array([0, 1, 1]))
    assert one[0].any() and not one[1].any()


def test_groups_equal_brute_force(spark, docs):
    rows = []
    for g in range(6):
        base = sentence(g, 60 + g)
        for c in range(7):
            w = list(base)
            for e in range(c % 4):
                w[(7 * e + 3 * c) % len(w)] = f"edit{g}-{c}-{e}"
            rows.append((100 * g + c, " ".join(w).title() if c == 5 else "  ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE two"), (905, "one"), (906, rows[0][1]), (3, rows[3][1]), (None, rows[0][1])]
    rows.append((950, " ".join(sentence(0, 61) * 400)))
    got = minhash.near_duplicates(docs(rows), k=4, percent=80).collect()
    want = brute(rows, 4, 80)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert r.component_id == want[r.doc_id], r
        assert r.kept == (r.doc_id == want[r.doc_id])
    sizes = {(r.doc_id, r.n_shingles) for r in got}
    assert sizes == {(i, len(shingle_set(t, 4))) for i, t in rows}


def test_large_groups_are_compared_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 4000)
    base = sentence(3, 80)
    rows = []
    for c in range(40):
        w = list(base)
        w[c % 80] = f"x{c}"
        if c % 3 == 0:
            w[(c + 31) % 80] = f"y{c}"
        rows.append((c, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), k=5, percent=80).collect()}
    assert got == brute(rows, 5, 80)


def test_sizes_at_the_border_are_kept():
    """A text and one that contains its whole set, of sizes 4k and 5k: the sizes leave exactly 80 % tenable, and not 81 %."""
    from keelson.llm.words import mix

    for n in (4, 8, 80, 400):
        e = mix(np.arange(n * 5 // 4, dtype=np.uint64) + np.uint64(n * 1000))
        r = minhash.registers(np.concatenate([e[:n], e]), np.array([0, n, n + len(e)]))
        sizes = np.array([n]), np.array([len(e)])
        for (i, j), (a, b) in (((0, 1), sizes), ((1, 0), sizes[::-1])):
            assert minhash.plausible(r[i : i + 1], r[j : j + 1], a, b, 0.80)[0]
            assert not minhash.plausible(r[i : i + 1], r[j : j + 1], a, b, 0.81)[0]
    # No size pair (4k, 5k) is refused, and each pair that is one shingle further apart is.
    k = np.arange(1, 10_001)
    same = np.broadcast_to(r[:1], (len(k), minhash.M))
    assert minhash.plausible(same, same, 4 * k, 5 * k, 0.8).all() and minhash.plausible(same, same, 5 * k, 4 * k, 0.8).all()
    assert not minhash.plausible(same, same, 4 * k - 1, 5 * k, 0.8).any()


def test_border_groups_equal_brute_force(spark, docs):
    """Pairs of Jaccard similarity exactly 4/5 and 80/100, and ones just below, in both orders of size."""
    rows = []
    for g in range(20):
        w = sentence(g, 8, salt=g)
        rows += [(10 * g + g % 2, " ".join(w[:7])), (10 * g + 1 - g % 2, " ".join(w))]
        w = sentence(100 + g, 104, salt=g)
        cut = 83 if g < 15 else 82
        rows += [(10 * g + 5 + g % 2, " ".join(w[:cut])), (10 * g + 6 - g % 2, " ".join(w[:103]))]
    want = brute(rows, 4, 80)
    assert sum(i != c for i, c in want.items()) == 35
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs(rows), k=4, percent=80).collect()}
    assert got == {i: (c, i == c) for i, c in want.items()}


def test_empty_table(spark, docs):
    out = minhash.near_duplicates(docs([]))
    assert out.collect() == [] and out.columns == ["doc_id", "n_shingles", "component_id", "kept"]


@pytest.mark.parametrize("shape", ["chain", "star", "none"])
def test_components(spark, shape):
    n = 70
    pairs = {"chain": [(i + 1, i) for i in range(n)], "star": [(n, i) for i in range(n)] + [(n, n), (None, 3)], "none": []}[shape]
    got = components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()
    assert {r.node: r.component for r in got} == ({i: 0 for i in range(n + 1)} if pairs else {})


def test_chains_and_pairs_across_blocks(spark, docs, monkeypatch):
    """Texts that drift, each near its neighbours only, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 3000)
    rows, w = [], sentence(7, 60)
    for c in range(60):
        w = list(w)
        w[(13 * c) % 60] = f"z{c}"
        if c % 9 == 8:
            w[(13 * c + 30) % 60] = f"q{c}"
        rows.append(((37 * c) % 61, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows), k=4, percent=80).collect()}
    assert got == brute(rows, 4, 80)


def test_tight_group_needs_few_tests(monkeypatch):
    """Each text of a tight group is tested about once, however many share its bands."""
    base = np.sort(minhash.mix(np.arange(200, dtype=np.uint64)))
    sets = [np.sort(np.append(base[np.arange(200) != c % 200], minhash.mix(np.array([10_000 + c], dtype=np.uint64)))) for c in range(2000)]
    at = np.arange(len(sets) + 1) * 200
    row = {
        "ids": list(range(len(sets))), "sketches": minhash.registers(np.concatenate(sets), at).tobytes(),
        "ends": at[1:].astype(np.int64).tobytes(), "elements": np.concatenate(sets).tobytes(),
    }
    tests, similar = [], minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda *a: tests.append(1) or similar(*a))
    block = minhash._Block(row)
    assert len(list(minhash._links(block, block, 80))) == 1999 and len(tests) < 2500
