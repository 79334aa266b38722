import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from keelson.operators import medians as M


def bits(x):
    if math.isnan(x):
        return 2**63 - 1
    b = struct.unpack("q", struct.pack("d", abs(x)))[0]
    return -b if x < 0 else b


def test_ordered_bits_are_those_of_the_double(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan]
    xs += [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(5000)]
    xs += [2.0**k for k in range(-1074, 1024)] + [-math.nextafter(2.0**k, 0) for k in range(-1070, 1024)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", M.ordered_bits(F.col("x")).alias("k")).collect()
    assert all(r.k == bits(r.x) for r in rows)


def make(n=2000):
    rng = random.Random(2)
    near = lambda: 100 + rng.random() * 1e-9  # noqa: E731  All digits but the last few agree.
    return [
        (rng.choice(["a", "b", None]), rng.randrange(2000, 2006), rng.choice([None, rng.gauss(0, 1), 1.0, float(rng.randrange(5))]), rng.choice([None, near()]), None)
        for _ in range(n)
    ]


SCHEMA = "g string, season int, x double, y double, z double"


@pytest.mark.parametrize("cells", [1 << 20, 1])
def test_equal_to_the_median_of_a_sorted_group(spark, cells, monkeypatch):
    """Also through all rounds; with null groups and values, repeated values, a column without any value."""
    monkeypatch.setattr(M, "CELLS", cells)
    t = spark.createDataFrame(make(), SCHEMA)
    got = sorted(map(tuple, M.medians(t, ["g"], ["x", "y", "z"]).collect()), key=repr)
    want = sorted(map(tuple, t.groupBy("g").agg(F.median("x"), F.median("y"), F.median("z")).collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[3] is None for g in got)
    assert all(abs(g[2] - w[2]) < 1e-13 for g, w in zip(got, want, strict=True))


def test_expanding_windows(spark):
    rows = make()
    t = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.year): r.medians for r in M.expanding_medians(t, ["g"], [F.col("x"), F.col("z")], "season", list(range(2000, 2008))).collect()}
    assert set(got) == {(g, y) for g in ("a", "b", None) for y in range(2001, 2008)}
    for (g, y), m in got.items():
        assert m == [statistics.median(x for k, s, x, *_ in rows if k == g and s < y and x is not None), None]


def test_one_group_of_all_rows(spark):
    """A group of 300,000 different values in eight partitions: counts only, whatever the group's size."""
    t = spark.range(0, 300_000, 1, 8).select(F.lit("all").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(300_000)) / 7).alias("x"))
    assert M.medians(t, ["g"], ["x"]).first()["_m_x"] == (149_999 / 7) / 2 + (150_000 / 7) / 2
    counts = M._rounds(t, ["g"], [F.col("x")], F.lit(0), None)
    assert "percentile" not in counts._jdf.queryExecution().optimizedPlan().toString().lower()


def test_no_rows(spark):
    assert M.medians(spark.createDataFrame([], SCHEMA), ["g"], ["x"]).count() == 0
