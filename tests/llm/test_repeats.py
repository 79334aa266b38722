import hashlib

import numpy as np

from keelson.llm import repeats

from .conftest import WORD, sentence


def brute(rows, width=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def make():
    passage = sentence(99, 70)
    rows = [(1, " ".join(sentence(1, 40) + passage + sentence(2, 30))), (2, "\n".join(sentence(3, 10) + passage[5:65] + sentence(4, 60)))]
    rows += [(3, " ".join(passage[:49])), (4, " ".join(passage[:50])), (5, rows[0][1]), (6, rows[0][1].replace(" ", "\t")), (7, None), (8, ""), (9, "a b")]
    rows += [(10, " ".join(sentence(5, 55) + passage + sentence(5, 55) + passage)), (11, " ".join(sentence(5, 55) + passage[::-1])), (None, rows[0][1]), (1, rows[0][1])]
    rows += [(20 + k, " ".join(sentence(30 + k, 8) + passage + sentence(60 + k, 8 + k))) for k in range(25)]
    rows += [(60, " ".join(sentence(1, 40) + ["naïve", "漢字"] + passage[:60])), (61, " ".join(["naïve", "漢字"] + passage[:60]))]
    rows.append((70, " ".join(["same"] * 120)))
    rows.append((71, " ".join(["same"] * 90 + ["other"])))
    return rows


def digest(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, docs):
    rows = make()
    got = repeats.removed_words(docs(rows))
    assert digest(got) == brute(rows)
    for r in got.where("n_removed > 0").collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_split_shards_agree(spark, docs, monkeypatch):
    """A shard whose text is spread over several tasks gives the same result."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1500)
    rows = make()
    assert digest(repeats.removed_words(docs(rows))) == brute(rows)


def test_long_recurring_document_is_cut_into_pieces(spark, docs, monkeypatch):
    """A document that owns all its phrases goes to many shards, in pieces, none of which is long."""
    monkeypatch.setattr(repeats, "SHARD_PHRASES", 40)
    monkeypatch.setattr(repeats, "PIECE_WINDOWS", 64)
    long = sentence(7, 4000)
    rows = [(1, " ".join(long)), (2, " ".join(["more"] + long[100:3900])), (3, "\t".join(long[2000:2300] + sentence(8, 60)))]
    rows += [(4, " ".join(long[40:89])), (5, " ".join(long[40:90])), (2, " ".join(long[:3000] + ["end"]))]
    assert digest(repeats.removed_words(docs(rows))) == brute(rows)


def test_windows_are_compared_by_words():
    """Equal runs of words get one number, others different ones."""
    r = np.random.default_rng(3)
    codes = np.concatenate([r.integers(0, 2, 200), np.zeros(120, dtype=np.int64), r.integers(0, 2, 80)])
    codes = np.concatenate([codes, codes[20:180]])
    got = repeats._same(codes, 2)
    runs = [tuple(codes[i : i + repeats.WINDOW].tolist()) for i in range(len(codes) - repeats.WINDOW + 1)]
    first = {}
    assert len(got) == len(runs)
    assert all(first.setdefault(x, y) == y for x, y in zip(runs, got.tolist(), strict=True))
    assert len(first) == len(set(got.tolist()))


def test_empty_table(spark, docs):
    assert repeats.removed_words(docs([])).collect() == []


def test_selected_phrase_lies_in_its_window():
    from keelson.llm.words import windows

    h = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    g, best = windows(h, repeats.PHRASE), repeats._selected(h)
    width = repeats.WINDOW - repeats.PHRASE + 1
    assert best.tolist() == [g[i : i + width].min() for i in range(len(h) - repeats.WINDOW + 1)]
