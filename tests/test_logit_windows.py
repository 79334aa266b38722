import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import backtest, models
from keelson.operators import windows as W

from .test_windows import OWN, SCHEMA_AT, SEASONS, make

SCHEMA = "entry_key string, season int, model_group string, target double, prior double, a double, b double, c double, d double, e double, label int"
GATES = backtest.Gates(40, 8, 20, 5, 5, 3)


def labelled():
    """``K`` has no predictors; all of ``P`` before 2016 have one class, so its inner years begin late."""
    rng, out = random.Random(5), []
    for r in make():
        p = 1 / (1 + np.exp(-(((r[5] or 1e6) - 1e6) / 40 + (r[7] - 1) * 0.8)))
        out.append((*r, 1 if r[2] == "P" and r[1] < 2016 else int(rng.random() < p)))
    return out


def plain_fit(train, own, l2):
    """Medians, scaling and Newton steps of one window on whole arrays."""
    x = np.array([[np.nan if (v := r[SCHEMA_AT[c]]) is None else v for c in own] for r in train], dtype=float).reshape(len(train), len(own))
    med = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    full = np.where(np.isnan(x), med, x)
    mean, sd = full.mean(axis=0), full.std(axis=0)
    sd[sd < 1e-9] = 1.0

    def vectors(rows):
        v = np.array([[np.nan if (w := r[SCHEMA_AT[c]]) is None else w for c in own] for r in rows], dtype=float).reshape(len(rows), len(own))
        out = [np.ones(len(rows))]
        for k in range(len(own)):
            gone = np.isnan(v[:, k])
            out += [(np.where(gone, med[k], v[:, k]) - mean[k]) / sd[k], gone.astype(float)]
        return np.column_stack(out)

    beta = models.logistic_newton(vectors(train), np.array([r[-1] for r in train], dtype=float), l2)
    return lambda rows: models.probability_of(vectors(rows) @ beta)


def plain_rolling(rows, years, columns, grid, default):
    out = {}
    for g in OWN:
        own = columns[g] if isinstance(columns, dict) else columns
        mine = [r for r in rows if r[2] == g]
        for y in years:
            train, hold = [r for r in mine if r[1] < y], [r for r in mine if r[1] == y]
            ones = sum(r[-1] for r in train)
            if len(train) < 40 or len(hold) < 8 or min(ones, len(train) - ones) < 5:
                continue
            off = {a: [] for a in grid}
            for v in SEASONS:
                before, at = [r for r in train if r[1] < v], [r for r in train if r[1] == v]
                ones = sum(r[-1] for r in before)
                if len(before) >= 20 and len(at) >= 5 and min(ones, len(before) - ones) >= 3:
                    for a in grid:
                        off[a] += list((plain_fit(before, own, a)(at) - np.array([r[-1] for r in at])) ** 2)
            l2 = min(grid, key=lambda a: (sum(off[a]), a)) if off[grid[0]] else default
            out |= {(r[0], y): (l2, np.mean([t[-1] for t in train]), p) for r, p in zip(hold, plain_fit(train, own, l2)(hold), strict=True)}
    return out


@pytest.mark.parametrize("columns, grid", [(OWN, (0.1, 10.0)), (["a", "c"], (1.0, 100.0))])
def test_equals_fold_by_fold_fits(spark, columns, grid):
    """Probabilities of all windows against Newton steps on copied rows, with each group's own predictors; the default
    penalty isn't of the grid."""
    rows, years = labelled(), [2018, 2023]
    got = backtest.rolling_logistic(spark.createDataFrame(rows, SCHEMA), years, columns, "label", GATES, grid, 3.0).collect()
    want = plain_rolling(rows, years, columns, grid, 3.0)
    assert {(r.entry_key, r.holdout_year) for r in got} == set(want) and want
    assert all(r.l2 == want[r.entry_key, r.holdout_year][0] for r in got)
    assert np.allclose([(r.prevalence, r.probability) for r in got], [want[r.entry_key, r.holdout_year][1:] for r in got], rtol=0, atol=1e-7)


def test_default_where_no_inner_year_qualifies(spark):
    rows = [r for r in labelled() if r[2] in ("RB", "K") and r[1] >= 2021]
    t = spark.createDataFrame(rows, SCHEMA)
    got = backtest.rolling_logistic(t, [2022], OWN, "label", backtest.Gates(8, 8, 999, 5, 1, 1), (0.1,), 3.0).collect()
    assert got and {r.l2 for r in got} == {3.0}


def test_steps_read_rows_once_however_many_windows(spark, monkeypatch):
    """One job for each step, for all groups, windows and penalties; rows are written once and never copied."""
    written, write = {}, W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    steps, real = [], W._newton_sums
    monkeypatch.setattr(W, "_newton_sums", lambda fits: steps.append(len(fits)) or real(fits))
    t = spark.createDataFrame(labelled(), SCHEMA)
    fitted = W.fit_logistic(t, list(range(2010, 2024)), OWN, "label", (0.1, 1.0, 10.0))
    assert written["logit-rows"].count() == t.count()
    assert len(steps) < 15 and steps[0] == 3 * fitted.count() and steps == sorted(steps, reverse=True)


def test_more_fits_than_the_state_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(W, "MAX_STATE", 100)
    with pytest.raises(ValueError, match="too many fits"):
        W.fit_logistic(spark.createDataFrame(labelled(), SCHEMA), [2020], OWN, "label", (1.0,))
    monkeypatch.setattr(models, "MAX_STATE", 3)
    t = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.7)], "g string, y int, p double")
    with pytest.raises(ValueError, match="too many fits"):
        models.calibration(t, ["g"], "y", "p")


def test_no_rows_one_class_and_null_seasons(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert backtest.rolling_logistic(none, [2020], OWN, "label").count() == 0
    rows = [r for r in labelled() if r[2] == "P" and r[1] < 2016]
    assert W.fit_logistic(spark.createDataFrame(rows, SCHEMA), [2016], OWN, "label", (1.0,)).count() == 0
    rows = labelled() + [("odd", None, "RB", 0.0, None, 1.0, None, 1.0, None, None, 1)]
    a, b = (backtest.rolling_logistic(spark.createDataFrame(t, SCHEMA), [2020], OWN, "label", GATES, (1.0,)).orderBy("entry_key").collect() for t in (rows, rows[:-1]))
    assert a == b and a


def test_ridge_on_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(g, [1.0, *map(float, rng.normal(size=k))], float(rng.normal())) for g, k in (("a", 3), ("b", 1), ("c", 0)) for _ in range(30)]
    for r in models.fit_ridge(spark.createDataFrame(rows, "g string, x array<double>, y double"), ["g"], "x", "y", 2.0, 4).collect():
        x, y = (np.array([q[i] for q in rows if q[0] == r.g]) if i == 2 else np.array([q[1] for q in rows if q[0] == r.g]) for i in (1, 2))
        assert np.allclose(r.beta, models.ridge_solve(x.T @ x, x.T @ y, 2.0))


def test_negative_control_with_own_predictors(spark):
    """A group's figures are those of a run on that group alone with its list for all."""
    rows = [r for r in labelled() if r[2] in ("RB", "WR", "K")]
    t = spark.createDataFrame(rows, SCHEMA).withColumn("town", F.concat(F.lit("t"), F.col("c").cast("int")))
    own = {"RB": ["b"], "WR": ["c", "b"]}
    gates = backtest.Gates(40, 8, 20, 5)
    both = backtest.negative_control(t, 2023, own, "town", "target", gates)[1].collect()
    assert {r.model_group: r.status for r in both} == {"RB": "evaluated", "WR": "evaluated", "K": "evaluated"}
    for g, mine in (("RB", ["b"]), ("WR", ["c", "b"]), ("K", [])):
        alone = backtest.negative_control(t.where(F.col("model_group") == g), 2023, mine, "town", "target", gates)[1].first()
        r = next(x for x in both if x.model_group == g)
        assert (r.alpha, r.train_rows) == (alone.alpha, alone.train_rows) and np.isclose(r.mae, alone.mae, rtol=1e-9)
