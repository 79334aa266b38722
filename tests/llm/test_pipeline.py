import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline as cp
from keelson.llm import bpe

from .conftest import WORD
from .test_minhash import brute as near_brute
from .test_repeats import brute as repeat_brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_their_decisions(spark, tmp_path):
    from .test_repeats import make

    texts = [(i, t) for i, t in make() if i is not None] + [(200 + k, f"clean words number {k} and a few more of them") for k in range(30)]
    bad = [(300 + k, f"you are a grobnax fellow {k} times over") for k in range(25)]
    seen, rows = set(), []
    for i, t in texts + bad:
        if i not in seen:
            seen.add(i)
            rows.append((i, t, "en", f"s{i % 2}", None if t is None else len(t)))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 300)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    assert len(cp.STAGES) == 5
    out = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted(r.doc_id for r in out[n]) for n in out}
    assert ids["toxicity"] == sorted(i for i, *_ in rows if i < 300)
    before = [(r.doc_id, r.text) for r in out["toxicity"]]
    want = near_brute(before, 5, 80)
    assert ids["near copies"] == sorted(i for i, _ in before if want[i] == i)
    before = [(r.doc_id, r.text) for r in out["near copies"]]
    for (i, n, gone, sha), r in zip(repeat_brute(before), sorted(out["repeated passages"], key=lambda r: repr((r.doc_id,))), strict=True):
        assert r.doc_id == i and hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == sha
        assert r.n_chars is None or r.n_chars == len(r.text)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path(cp.VOCABULARY), "rb").read()), special_tokens={})
    mixed = sorted((r.doc_id, enc.encode_ordinary(r.text or "")) for r in out["mixing"])
    assert sorted((r.doc_id, list(r.tokens)) for r in out["tokens"]) == mixed
    source = {r.doc_id: r.text for r in out["repeated passages"]}
    assert all(source[r.doc_id] == r.text for r in out["mixing"])
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 2


EXTRA = ", _score string, _kept int, _copy int, mix string, _mix int, id string, doc_id_ long, `a.b` string"


def run_stages(spark, docs, sf, tmp_path, name):
    out = []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / f"{name}{k}"))
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls in all columns, repeated rows and ids, empty and long texts; further columns pass through all stages."""
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    rows = [(i, f"plain words number {i} stand here {i * 7}", "en", f"s{i % 2}", 30) for i in range(40)]
    rows += [(None, None, None, None, None), (50, None, "en", None, None), (51, "", "en", "s0", 0), (52, long, "en", "s1", len(long))]
    rows += [(3, rows[3][1], "en", "s1", 30)] * 3 + [(4, "another text under a known id", "de", "s0", 29), (None, "words without an id", "en", "s0", 19)]
    extra = ("x", 1, 2, "m", 3, "i", 4, "dotted")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], DOCS + EXTRA)
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = run_stages(spark, docs, str(tmp_path), tmp_path, "odd")
    for df in out[:4]:
        assert df.columns == docs.columns
        assert {tuple(r[5:]) for r in df.collect()} == {extra}
    assert {r.doc_id for r in out[1].where("text is null or text = ''").collect()} <= {None, 50, 51}
    both = cp.drop_repeats(spark, spark.createDataFrame([(1, long, "en", "s", 9), (2, long + " tail", "en", "s", 9), (2, "short", "en", "s", None)], DOCS), "").collect()
    assert sorted((r.doc_id, len(r.text), r.n_chars) for r in both if r.text != "short") == [(1, len(long), 9), (2, 4, 4)]
    assert [(r.text, r.n_chars) for r in both if r.text == "short"] == [("short", None)]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = run_stages(spark, spark.createDataFrame([], DOCS), str(tmp_path), tmp_path, "none")
    assert [df.count() for df in out] == [0] * 5


def test_run_leaves_only_the_stages_tables(spark, tmp_path):
    import os

    spark.createDataFrame([(i, f"word{i} and more {i}", "en", "s", 9) for i in range(20)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    from keelson.llm.scratch import shared_dir

    folder = os.path.join(shared_dir(spark).removeprefix("file:"), "keelson")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == sorted(f"stage-{n.replace(' ', '-')}" for n, _ in cp.STAGES)
