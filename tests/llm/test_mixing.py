import math

from pyspark.sql import functions as F

from keelson.llm import mixing

from .conftest import WORD


def targets_brute(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        deal = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if deal[s] > cap * sizes[s]}
        if not full:
            out.update(deal)
            break
        out.update({s: cap * sizes[s] for s in full})
        open_ -= full
    return out


def test_words():
    assert WORD.findall(" a\x0bb c ") == ["a", "b c"]


def make(n=400):
    texts, sources = [], []
    for i in range(n):
        size = 1 + (i * i * 31) % 97
        texts.append((i, " ".join(f"t{(i * k) % 50}" for k in range(size))))
        sources.append("big" if i % 3 == 0 else ("B", "a", "Z", "é", None)[i % 5])
    texts += [(n, None), (n + 1, ""), (None, "no id at all"), (5, texts[5][1])]
    sources += ["big", "empty", "a", sources[5]]
    return texts, sources


def test_mix_against_brute_force(spark, docs):
    texts, sources = make()
    df = docs(texts, sources)
    mixed = mixing.mix_sources(df)
    assert mixed.columns == [*df.columns, "_mix"]
    rows = [r for r in mixed.select("doc_id", "text", "source", "_mix.*").collect()]
    assert len(rows) == len(texts)
    sizes = {}
    for (_, t), s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_brute(sizes)
    taken, most = {}, {}
    for r in rows:
        n = len(WORD.findall(r.text or ""))
        assert r.size == n and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] = taken.get(r.source, 0) + n * r.copies
        most[r.source] = max(n, most.get(r.source, 0))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1, s
    again = mixing.mix_sources(df.repartition(7)).select("doc_id", "text", "_mix.copies").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed.select("doc_id", "text", "_mix.copies").collect()))


def test_ranks_are_pareto(spark):
    """The cut equals taking documents one by one in the order of their odds ratios."""
    rows = [(s, 1 + i % 13, float(1 + i % 13) ** 0.5, (i * 0.6180339887) % 1) for s in ("x", "y") for i in range(200)]
    df = spark.createDataFrame(rows, "source string, size long, weight double, u double")
    plan = {r.source: r for r in mixing.plan(df, (5, 1), 0.6, 2.0).collect()}
    for s in ("x", "y"):
        p, docs, used = plan[s], [], 0.0
        for _, size, weight, u in (r for r in rows if r[0] == s):
            e = min(2.0, p.c * weight)
            used += math.floor(e) * size
            pi = e - math.floor(e)
            odds = (u / (1 - u)) / (pi / (1 - pi)) if pi > 0 else math.inf
            docs.append((odds, size, odds / (1 + odds) if odds < math.inf else 1.0))
        assert used <= p.target * (1 + 1e-9)
        open_ = p.target - used
        got = [d for d in docs if d[2] < p.below and (not p.cut or (d[2], d[1]) < (p.cut.rank - 1e-12, 0))]
        want, cum = [], 0
        for d in sorted(docs):
            if cum + d[1] / 2 > open_:
                break
            want.append(d)
            cum += d[1]
        assert sorted(got) == sorted(want)


def test_copies_follow_the_inclusion_odds(spark, docs):
    """Longer texts are taken more often than shorter ones of the same source."""
    texts = [(i, " ".join(["w"] * (10 if i % 2 else 160))) for i in range(3000)]
    mixed = mixing.mix_sources(docs(texts, ["s"] * 3000), weights=(1,), share=0.5)
    rates = {r.size: r.rate for r in mixed.groupBy("_mix.size").agg(F.avg("_mix.copies").alias("rate")).collect()}
    assert 2.5 < rates[160] / rates[10] < 6


def test_equal_rows_are_cut_inside(spark, docs):
    """Equal rows have one rank; as many of them are taken as fit, on any layout of the table."""
    texts = [(7, "a b c")] * 40 + [(8, "d e f g")] * 3 + [(9, "x " * 30)]
    df = docs(texts, ["s"] * 43 + ["t"])
    for table in (df, df.repartition(5)):
        rows = mixing.mix_sources(table, weights=(1, 1), share=0.5).select("doc_id", "_mix.*").collect()
        assert len(rows) == 44
        taken = sum(r.size * r.copies for r in rows if r.doc_id < 9)
        assert abs(taken - next(r.target for r in rows if r.doc_id < 9)) <= 2


def test_empty(spark, docs):
    assert mixing.mix_sources(docs([])).collect() == []
    assert [r._mix.copies for r in mixing.mix_sources(docs([(1, None)])).collect()] == [0]
