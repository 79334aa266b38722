import random
import statistics

from pyspark.sql import functions as F

from keelson.operators import backtest, metrics

PANEL = "entry_key int, season int, model_group string, destination string, prior_change double"
BY = ["holdout_year", "model_group"]


def panel(n=90):
    """Null groups, seasons, keys and values, keys in several spellings, a group without training rows, one without values, equal rows."""
    rng = random.Random(11)
    key = lambda: rng.choice(["Rice", " rice", "NAVY", "navy ", "", " ", None, "ucla"])
    rows = [(i, rng.choice([2022, 2023, 2024, 2025, None]), rng.choice(["QB", "WR", None]), key(), rng.choice([None, rng.randint(-9, 9) / 2])) for i in range(n)]
    rows += [(n, 2024, "late", "rice", 1.0), (n + 1, 2023, "none", "rice", None), (n + 2, 2024, "none", "rice", 2.0), (n + 3, 2024, "QB", "unseen", 3.0)]
    return [*rows, *rows[:5]]


def test_signal_equals_plain_means(spark):
    rows = panel()
    for years in ([2024], [2023, 2024]):
        folded = [(*r, y, "train" if r[1] < y else "holdout") for y in years for r in rows if r[1] is not None and r[1] <= y]
        plain = lambda k: (k or "").strip(" ").lower()
        want = []
        for r in folded:
            whole = [x[4] for x in folded if x[6] == "train" and x[5] == r[5] and None not in (x[2], r[2], x[4]) and x[2] == r[2]]
            own = [x[4] for x in folded if x[6] == "train" and x[5] == r[5] and None not in (x[2], r[2], x[4]) and x[2] == r[2] and plain(x[3]) == plain(r[3]) != ""]
            mean = own or whole
            want.append((*r, round(statistics.fmean(mean), 9) if mean else None))
        t = metrics.encode_in_folds(backtest.folds(spark.createDataFrame(rows, PANEL), years), BY, "destination", "prior_change")
        assert set(t.columns) == {*PANEL.replace(",", "").split()[::2], "holdout_year", "part", "signal"}
        got = t.select("entry_key", "season", "model_group", "destination", "prior_change", "holdout_year", "part", F.round("signal", 9)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) > 40


def test_one_year_s_filters_reach_the_table(spark, tmp_path):
    """Of one holdout year the parts are filters of the table itself, and rows without a value are left before they are summed."""
    spark.createDataFrame(panel(), PANEL).write.parquet(f"{tmp_path}/panel")
    folded = backtest.folds(spark.read.parquet(f"{tmp_path}/panel"), [2024])
    assert dict(folded.dtypes)["holdout_year"] == "int"
    t = metrics.encode_in_folds(folded, BY, "destination", "prior_change").where("part = 'holdout'")
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    read = [lines[i - 1] for i, x in enumerate(lines) if "Relation [" in x]
    assert "Generate" not in plan and len(read) == 3 and all("Filter" in x and "2024" in x for x in read), plan
    summed = [x for x in read if "isnotnull(prior_change" in x]
    assert len(summed) == 2, read
    # Both readers of the sums read the same rows, blank keys included, so their shuffle is one.
    assert not [x for x in lines if "Filter" in x and "lower" in x], plan
