import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa

from keelson.llm import language, queries

DIR = "/root/testdata/sf0.01"

WORDS = {
    "en": "the of and with thing stone water other about which there would",
    "de": "der und nicht über schön straße wasser andere könnte durch zwischen",
    "ru": "это вода камень который может другой между через красивый слово",
}


def normal(text):
    """Lower case, one blank for all but letters and marks, a blank at either end."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    kept = re.sub(" +", " ", kept).strip(" ")
    return f" {kept} " if kept else " "


TEXTS = ["Hallo, Welt!", "", "  ", None, "É1à", "...x", "x...", "日本 語!", "123", "ab", "Žižek\n\nfoo  bar", "e\u0301t", "𝔘x"]


def test_points_equal_plain_normalisation():
    points, ends, letters = language._points(pa.array(TEXTS).fill_null(""))
    begin = [0, *ends.tolist()[:-1]]
    assert ["".join(map(chr, points[a:b].tolist())) for a, b in zip(begin, ends.tolist(), strict=True)] == [normal(t) for t in TEXTS]
    assert letters.tolist() == [any(unicodedata.category(c)[0] == "L" for c in t or "") for t in TEXTS]


def test_rows_depend_on_the_gram_alone():
    points, ends, _ = language._points(pa.array(TEXTS).fill_null(""))
    seen = {}
    for n in language.GRAMS:
        rows, a = language._rows(points, ends, n).tolist(), 0
        for b in ends.tolist():
            for i in range(a, b):
                gram = tuple(points[i : i + n].tolist()) if i + n <= b else None
                assert (rows[i] == language.MISS) == (gram is None)
                assert gram is None or seen.setdefault(gram, rows[i]) == rows[i]
            a = b


def sample(n=240, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((" ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, 30))), lang))
    return out


def plain_values(text, inverse):
    points, _, _ = language._points(pa.array([text]))
    rows = language._text_rows(points).tolist()
    return {r: rows.count(r) / len(rows) * inverse[r] for r in set(rows)}


def test_frequency_and_scores_equal_brute_force():
    rows = sample()
    texts = [t for t, _ in rows]
    batch = pa.record_batch([pa.array([*texts, None, "..."])], names=["text"])
    found = next(iter(language._frequency(iter([batch]))))
    have = dict(zip(found["row"].to_pylist(), found["n"].to_pylist(), strict=True))
    want = {}
    for t in [*texts, "", "..."]:
        points, _, _ = language._points(pa.array([t]))
        for r in set(language._text_rows(points).tolist()):
            want[r] = want.get(r, 0) + 1
    assert have == {**want, language.MISS: len(texts) + 2}
    frequency = np.zeros(language.MISS, dtype=np.int64)
    for r, n in want.items():
        frequency[r] = n
    m = language.train(texts, [lang for _, lang in rows], frequency, len(texts))
    assert 0 < len(m.rows) < np.count_nonzero(frequency)  # sparse
    points, ends, _ = language._points(pa.array(texts))
    got = language.logits(m, points, ends)
    weight = dict(zip(m.rows.tolist(), m.weight, strict=True))
    for i, t in enumerate(texts):
        # The model's weights hold the inverse document frequency already.
        z = sum((v * weight[r] for r, v in plain_values(t, np.ones(language.MISS)).items() if r in weight), m.bias)
        assert np.allclose(got[i], z)


def test_follow_is_the_leader_step_by_step():
    """Against a plain version that keeps all gradients and minimises the regularised sum in closed form."""
    rng = np.random.default_rng(1)
    texts = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3)) for _ in range(12)]
    label = rng.integers(0, 3, 12)
    w, bias = language.follow(texts, label, 3, epochs=2)
    last = language.MISS
    order, z, squares = np.random.default_rng(11), {}, {}
    weights = lambda r, k: language_weight(z.get((r, k), 0.0), squares.get((r, k), 0.0), r == last)
    for _ in range(2):
        for i in order.permutation(12).tolist():
            x = {**dict(zip(texts[i][0].tolist(), texts[i][1].tolist(), strict=True)), last: 1.0}
            now = {(r, k): weights(r, k) for r in x for k in range(3)}
            e = np.exp([sum(x[r] * now[r, k] for r in x) for k in range(3)])
            p = e / e.sum()
            for r in x:
                for k in range(3):
                    g = x[r] * (p[k] - (k == label[i]))
                    s = squares.get((r, k), 0.0)
                    z[r, k] = z.get((r, k), 0.0) + g - ((s + g * g) ** 0.5 - s**0.5) / language.ALPHA * now[r, k]
                    squares[r, k] = s + g * g
    assert np.allclose(bias, [weights(last, k) for k in range(3)])
    assert np.allclose(w[:6], [[weights(r, k) for k in range(3)] for r in range(6)])


def language_weight(z, s, free):
    size = max(abs(z) - (0 if free else language.L1), 0)
    return -np.sign(z) * size / ((language.BETA + s**0.5) / language.ALPHA + language.L2)


def test_temperature_minimises_the_log_loss():
    rng = np.random.default_rng(2)
    logits = rng.normal(0, 3, (400, 3))
    p = language._softmax(logits / 2.5)
    label = np.array([rng.choice(3, p=q) for q in p])
    t = language.calibrate(logits, label)
    loss = lambda t: -np.log(language._softmax(logits / t)[np.arange(400), label]).mean()
    assert 2 < t < 3.1 and loss(t) <= min(loss(x) for x in np.linspace(0.5, 6, 300)) + 1e-9


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_rows(spark):
    """Null ids, texts and languages, no letters, a language that only held-out rows have, repeated rows, clashing names."""
    rows = [(i, t, lang, "s", 1, "x", 0.5, "y") for i, (t, lang) in enumerate(sample(400))]
    more = [(None, "the water", "en", "s", 1, "x", 0.5, "y"), (900, None, "en", "s", 1, "x", 0.5, "y"), (901, "12 !", "en", "s", 1, "x", 0.5, "y"), (902, "der und nicht", None, "s", 1, "x", 0.5, "y")]
    only = next(i for i in range(1000, 1100) if held(i))
    more += [(only, "aku kamu", "id", "s", 1, "x", 0.5, "y"), rows[5], (903, "", "en", "s", 1, "x", 0.5, "y")]
    more.append((904, "вода камень " * 30_000, "ru", "s", 1, "x", 0.5, "y"))
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, id string, n int, lang_pred string, score double, turn string")
    out = language.identify(docs, language.fit(docs)).collect()
    assert len(out) == len(rows) + len(more)
    got = {r.doc_id: r for r in out}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out} == {"en", "de", "ru", "und"}
    assert [got[i].lang_pred for i in (900, 901, 903, 902, 904, None)] == ["und", "und", "und", "de", "ru", "en"]
    assert all(got[i].lang_pred == lang for i, (_, lang) in enumerate(sample(400)) if held(i))
    again = language.identify(docs, language.fit(docs)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert language.identify(empty, language.fit(empty)).count() == 0
    none = spark.createDataFrame([(1, "abc", None), (2, None, "en")], schema)
    assert {(r.lang_pred, r.score) for r in language.identify(none, language.fit(none)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "abc", "en") for i in range(9)], schema)
    assert {r.lang_pred for r in language.identify(one, language.fit(one)).collect()} == {"en"}


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(sample(300))]
    wrong = [(i, t, "xx" if held(i) else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (spark.createDataFrame(r, schema) for r in (rows, wrong))
    out = [sorted(map(repr, language.identify(d, language.fit(d)).collect())) for d in (a, b)]
    assert out[0] == out[1]


def test_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    out = queries.op11_language(spark, DIR).collect()
    assert len(out) == len(docs)
    tested = [r for r in out if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in tested]) > 0.95


def test_bounds_of_the_sample(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(sample(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs, max_docs=30, max_per_language=10, max_bytes=3000)
    assert m.languages == ["de", "en", "ru"]
