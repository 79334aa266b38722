import zlib

import numpy as np
import pytest

from keelson.llm import toxicity

from .conftest import WORD

BAD = ["grobnax", "fwilkor", "zuntrep"]


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "re", "mi", "so", "lun", "ke", "dor", "pa", "vi", "ech"]
    out, y = [], []
    for _ in range(n):
        words = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            w = BAD[rng.integers(len(BAD))]
            if rng.random() < 0.5:
                k = rng.integers(1, len(w))
                w = w[:k] + w[k - 1] + w[k:]
            words[rng.integers(len(words))] = w
        out.append(" ".join(words))
        y.append(int(bad))
    return out, np.array(y)


def logits(model, rows):
    raw = [t.encode() for t in rows]
    return toxicity.log_odds(model, np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*texts(500))


def test_held_out_accuracy(model):
    rows, y = texts(400, seed=1)
    assert ((logits(model, rows) > 0) == y).mean() > 0.95


def test_misspellings_share_grams(model):
    plain = "tare miso kedor pavi solun " * 4
    z = logits(model, [plain, plain + "grobnax", plain + "grobnnax", plain + "gr0bnax", plain + "Grobnaxes"])
    assert (z[1:] > z[0]).all() and z[1] > 0 and z[2] > 0


def test_long_texts_are_scored_whole(model):
    plain = "tare miso kedor " * 20_000
    z = logits(model, [plain, plain + "grobnax"])
    assert z[0] < 0 < z[1]


def test_training_and_scoring_agree(model):
    one = logits(model, ["tare grobnax", "miso kedor"])
    assert one.tolist() == [logits(model, ["tare grobnax"])[0], logits(model, ["miso kedor"])[0]]


def test_degenerate_training():
    for rows, y in (([], []), (["a"], [1]), (["a", "b"], [0, 0]), (["", ""], [0, 1])):
        z = logits(toxicity.train(rows, np.array(y)), ["a", ""])
        assert np.isfinite(z).all()


def test_a_refused_text_takes_no_room(monkeypatch):
    """A text beyond its class's bound is passed over; shorter ones after it are still learnt from."""
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda t, y: seen.append((t, y.tolist())) or toxicity.Model(np.zeros(1), 0.0))
    batch = pa.record_batch([pa.array(["a" * 60, "b" * 60, "c" * 30, "d" * 10, "e"]), pa.array([0, 0, 1, 1, 1])], names=["text", "y"])
    list(toxicity._train_batches(200)(iter([batch])))
    assert seen == [(["a" * 60, "c" * 30, "d" * 10, "e"], [False, True, True, True])]


def test_operator(spark, docs):
    rows, y = texts(260, seed=2)
    table = [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (None, rows[0]), (0, rows[0])]
    labels = spark.createDataFrame([(i, 1, int(v)) for i, v in enumerate(y)] + [(5, 1, None), (None, 1, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    df = docs(table)
    out = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(out) == len(table) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 260]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9
    # Labels of held-out rows have no influence.
    flipped = labels.selectExpr("doc_id", "quality", "case when pmod(crc32(cast(doc_id as string)), 5) = 0 then 1 - toxic else toxic end as toxic")
    again = {(r.doc_id, r.score) for r in toxicity.score(df, toxicity.fit(df, flipped)).collect()}
    assert again == {(r.doc_id, r.score) for r in out}
    assert toxicity.score(docs([]), toxicity.fit(docs([]), labels)).collect() == []


def test_scores_against_brute_force():
    """A word is the mean of its n-grams' numbers, a passage the mean of two words, a text the soft maximum of passages."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 3, 1 << toxicity.BITS), -0.7)

    def row(gram: bytes) -> int:
        return int(toxicity._rows(np.frombuffer(gram, dtype=np.uint8), len(gram))[0])

    def word(w: bytes) -> float:
        w = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" "
        rows = [model.gram[row(w[i : i + n])] for n in toxicity.GRAMS for i in range(len(w) - n + 1)]
        return sum(rows) / len(rows)

    def brute(text: str) -> float:
        words = [word(w.encode()) for w in WORD.findall(text)]
        z = [np.mean(words[i : i + 2]) for i in range(max(len(words) - 1, 1))] if words else []
        return model.bias + (np.log(sum(np.exp(toxicity.SHARP * x) for x in z)) / toxicity.SHARP if z else 0.0)

    texts_ = ["", "one", "A b", "Some Words, and  naïve\tones", "漢字 x", "long " * 300, "a"]
    raw = [t.encode() for t in texts_]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = toxicity.log_odds(model, np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    assert np.allclose(got, [brute(t) for t in texts_], atol=1e-9)
