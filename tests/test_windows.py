import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import constants as C
from keelson.operators import backtest
from keelson.operators import windows as W

SCHEMA = "entry_key string, season int, model_group string, target double, prior double, a double, b double, c double, d double, e double"
OWN = {"RB": ["a", "b"], "WR": ["b", "c", "d"], "P": ["a", "b", "c", "d", "e"], "K": []}
SEASONS = range(2008, 2024)


def make():
    """Sixteen seasons, so that inner years lie more than ten before the first outer one; ``d`` is missing until 2015 and the
    same value until 2019, ``e`` always missing; a large offset in ``a``."""
    rng, rows = random.Random(3), []
    for g in OWN:
        for s in SEASONS:
            for i in range(rng.randint(8, 14) if s > 2010 else 21):
                a, b, c = 1e6 + rng.gauss(0, 50), rng.choice([None, rng.random()]), float(rng.randrange(3))
                d = None if s < 2015 else 2.5 if s < 2019 else rng.choice([None, rng.gauss(0, 1)])
                y = (a - 1e6) * 0.3 + (b or 0.2) * 20 + c * 4 + rng.gauss(0, 5)
                rows.append((f"{g}{s}-{i}", s, g, y, rng.choice([None, y + rng.gauss(0, 9)]), a if i % 5 else None, b, c, d, None))
    return rows


def plain_fit(train, own, flags, alpha):
    """Medians, scaling and normal equations of one window, row by row."""
    x = [[r[SCHEMA_AT[c]] for c in own] for r in train]
    med = [statistics.median(v) if (v := [r[k] for r in x if r[k] is not None]) else 0.0 for k in range(len(own))]
    full = np.array([[m if v is None else v for v, m in zip(r, med, strict=True)] for r in x]).reshape(len(x), len(own))
    mean, sd = full.mean(axis=0), full.std(axis=0)
    sd[sd < 1e-9] = 1.0

    def vector(row):
        out = [1.0]
        for k, c in enumerate(own):
            v = row[SCHEMA_AT[c]]
            out.append(((med[k] if v is None else v) - mean[k]) / sd[k])
            if flags:
                out.append(float(v is None))
        return np.array(out)

    z = np.array([vector(r) for r in train])
    penalty = np.eye(z.shape[1]) * alpha
    penalty[0, 0] = 0
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ np.array([r[3] for r in train]))
    return lambda row: float(vector(row) @ beta)


SCHEMA_AT = {c.split()[0]: k for k, c in enumerate(SCHEMA.split(", "))}


def plain_rolling(rows, years, columns, flags, gates, grid, default):
    out = {}
    for g in OWN:
        own = columns[g] if isinstance(columns, dict) else columns
        mine = [r for r in rows if r[2] == g]
        for y in years:
            train, hold = [r for r in mine if r[1] < y], [r for r in mine if r[1] == y]
            if len(train) < gates.train or len(hold) < gates.holdout:
                continue
            off = {a: [] for a in grid}
            for v in SEASONS:
                before, at = [r for r in train if r[1] < v], [r for r in train if r[1] == v]
                if len(before) >= gates.inner_train and len(at) >= gates.inner_valid:
                    for a in grid:
                        model = plain_fit(before, own, flags, a)
                        off[a] += [abs(model(r) - r[3]) for r in at]
            alpha = min(grid, key=lambda a: (sum(off[a]), a)) if off[grid[0]] else default
            model = plain_fit(train, own, flags, alpha)
            out |= {(r[0], y): (alpha, model(r)) for r in hold}
    return out


@pytest.mark.parametrize("columns, flags", [(OWN, True), (["a", "b", "c", "d"], False)])
def test_equals_fold_by_fold_fits(spark, columns, flags):
    """Predictions, and so betas, of all windows against fits of copied rows; penalties from all earlier years."""
    rows, gates = make(), backtest.Gates(40, 8, 20, 5)
    got = backtest.rolling_ridge(spark.createDataFrame(rows, SCHEMA), [2018, 2021, 2023], columns, "target", "prior", gates, flags, grid=(0.1, 10.0, 1000.0)).collect()
    want = plain_rolling(rows, [2018, 2021, 2023], columns, flags, gates, (0.1, 10.0, 1000.0), C.RIDGE_DEFAULT)
    assert {(r.entry_key, r.holdout_year) for r in got} == set(want)
    assert all(r.alpha == want[r.entry_key, r.holdout_year][0] for r in got)
    assert np.allclose([r.prediction for r in got], [want[r.entry_key, r.holdout_year][1] for r in got], rtol=1e-9, atol=1e-9)


def test_final_fit_on_own_predictors(spark):
    rows = make()
    t = spark.createDataFrame(rows, SCHEMA)
    got = backtest.final_fit(t.where("season < 2023"), t.where("season = 2023"), [2020, 2021], OWN, "target", backtest.Gates(40, 8, 20, 5), grid=(1.0,)).collect()
    assert len(got) == sum(r[1] == 2023 for r in rows)
    for g in OWN:
        model = plain_fit([r for r in rows if r[2] == g and r[1] < 2023], OWN[g], True, 1.0)
        mine = {r.entry_key: r.prediction for r in got if r.model_group == g}
        assert np.allclose([mine[r[0]] for r in rows if r[2] == g and r[1] == 2023], [model(r) for r in rows if r[2] == g and r[1] == 2023], rtol=1e-9, atol=1e-9)


def test_rows_are_not_copied_for_windows(spark):
    """The sums have a row per group and season, however many years and penalties are asked for."""
    t = spark.createDataFrame(make(), SCHEMA)
    shifts = t.select("model_group").distinct().withColumn("shift", F.array(*[F.lit(0.0)] * 5))
    sums = W.moments(t, shifts, OWN, "target")
    assert sums.count() == len(OWN) * len(SEASONS)
    one = sums.where("model_group = 'RB' and season = 2012").first()
    mine = [r for r in make() if r[2] == "RB" and r[1] == 2012]
    w = np.array([[1.0, r[5] or 0.0, r[6] or 0.0, r[5] is None, r[6] is None, r[3]] for r in mine], dtype=float)
    assert one.n == len(mine) and np.allclose(one.products[:21], (w.T @ w)[np.triu_indices(6)])


def test_no_rows(spark):
    t = spark.createDataFrame([], SCHEMA)
    assert backtest.rolling_ridge(t, [2020], OWN, "target", "prior").count() == 0
    assert backtest.final_fit(t, t, [2020], OWN, "target").count() == 0


def test_predictors_of_all_groups_are_named():
    assert set(C.PREDICTORS) == set(C.TARGETS) and all(p[0] == "baseline_pre_production" and p[-2:] == ("rating", "stars") for p in C.PREDICTORS.values())
    assert W.width(C.PREDICTORS) == 11 and len(W.names(C.PREDICTORS)) == len(set(W.names(C.PREDICTORS)))
