"""Rolling-origin evaluation: folds are rows, not loops.

A fold trains on all seasons before its holdout year. Ridge and logistic fits of all folds, inner validation years and
penalties share the rows (``windows``). Where predictors are encoded in each fold, folds come from a join with a short table
of years; inner years and penalties are further short tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.scratch import materialize
from . import metrics as M
from . import models
from . import windows as W


@dataclass(frozen=True)
class Gates:
    """Least rows of outer training and holdout, inner training and validation, and of each class (0: not checked)."""

    train: int
    holdout: int
    inner_train: int
    inner_valid: int
    each_class: int = 0
    inner_class: int = 0


# The gates of each evaluation.
HOLDOUT = Gates(50, 10, 10, 5)
CONTROL = Gates(40, 10, 20, 5)
ROLLING = Gates(40, 20, 20, 10)
OBSERVABILITY = Gates(40, 20, 20, 10, 5, 3)


def folds(rows: DataFrame, years: list[int]) -> DataFrame:
    """Rows with ``holdout_year`` and ``part`` train (season before) or holdout (that season)."""
    # One year is a literal, so that filters on a part reach the tables below, which they don't through an explode.
    table = F.lit(years[0]) if len(years) == 1 else F.explode(F.array(*[F.lit(y) for y in years]))
    t = rows.withColumn("holdout_year", table).where(F.col("season") <= F.col("holdout_year"))
    return t.withColumn("part", F.when(F.col("season") < F.col("holdout_year"), F.lit("train")).otherwise(F.lit("holdout")))


def fold_status(folded: DataFrame, gates: Gates, label: str | None = None) -> DataFrame:
    """One row per year and group that occurs: row counts and ``evaluated``, ``skipped_low_sample`` or, with a label,
    ``skipped_low_train_class_count``; skipped folds stay."""
    train, hold = F.col("part") == "train", F.col("part") == "holdout"
    aggs = [F.sum(train.cast("long")).alias("train_rows"), F.sum(hold.cast("long")).alias("holdout_rows")]
    ok = (F.col("train_rows") >= gates.train) & (F.col("holdout_rows") >= gates.holdout)
    classes = F.lit(True)
    if label:
        aggs += [F.sum((train & (F.col(label) == v)).cast("long")).alias(f"train_{n}") for n, v in (("positives", 1), ("negatives", 0))]
        classes = (F.col("train_positives") >= gates.each_class) & (F.col("train_negatives") >= gates.each_class)
    t = folded.groupBy("holdout_year", "model_group").agg(*aggs)
    return t.withColumn("status", F.when(~ok, F.lit("skipped_low_sample")).when(~classes, F.lit("skipped_low_train_class_count")).otherwise(F.lit("evaluated")))


def baselines(folded: DataFrame, status: DataFrame, target: str, prior: str | None) -> DataFrame:
    """Holdout rows of evaluated folds with the historical mean of their fold and the prior value (null where missing, or
    where no column is named)."""
    good = status.where(F.col("status") == "evaluated").select("holdout_year", "model_group")
    rows = folded.join(good, ["holdout_year", "model_group"], "left_semi")
    mean = rows.where("part = 'train'").groupBy("holdout_year", "model_group").agg(F.avg(target).alias("historical_mean"))
    return rows.where("part = 'holdout'").join(mean, ["holdout_year", "model_group"]).withColumn("returning", F.col(prior) if prior else F.lit(None).cast("double"))


def baseline_metrics(held: DataFrame, target: str) -> DataFrame:
    """Errors of the mean on all rows, and of mean and prior value on the rows that have one."""
    error = F.abs(F.col("historical_mean") - F.col(target))
    paired = F.col("returning").isNotNull()
    return held.groupBy("holdout_year", "model_group").agg(
        F.count("*").alias("n"),
        F.avg(error).alias("historical_mae"),
        F.sum(paired.cast("long")).alias("paired_n"),
        F.avg(F.when(paired, error)).alias("paired_historical_mae"),
        F.avg(F.abs(F.col("returning") - F.col(target))).alias("returning_mae"),
    )


def _vectors(folded: DataFrame, keys: list[str], columns: W.Predictors, flags: bool) -> DataFrame:
    """Adds ``x``: a row's own preprocessed predictors; a group that isn't named has none."""
    train, every = folded.where("part = 'train'"), W.names(columns)
    t = M.preprocess(folded, train, keys, every, flags)
    if not isinstance(columns, dict):
        return t.withColumn("x", models.vector(columns, flags))
    x = models.vector([], flags)
    for g, mine in columns.items():
        x = F.when(F.col("model_group") == g, models.vector(list(mine), flags)).otherwise(x)
    return t.withColumn("x", x)


def _size(columns: W.Predictors, flags: bool) -> int:
    return 1 + W.width(columns) * (2 if flags else 1)


#: Adds predictors to folded rows of given keys that are learnt from a fold's training rows.
Prepare = Callable[[DataFrame, list[str]], DataFrame]


def seasons_of(rows: DataFrame) -> list[int]:
    """All seasons of the rows, in order: as many numbers as there are calendar years."""
    return sorted(r[0] for r in rows.select(F.col("season").cast("int")).where("season is not null").distinct().collect())


def _chosen_by_windows(rows: DataFrame, inner: list[int], outer: DataFrame, years: list[int], columns: W.Predictors, target: str, gates: Gates,
                       flags: bool, grid: tuple[float, ...], default: float) -> DataFrame:
    """The fit of each row of ``outer`` (``model_group``, ``year``): ``train_rows``, ``shift``, ``alpha`` and ``model``."""
    fitted = materialize(W.fit(rows, sorted({*inner, *years}), columns, target, grid, flags), "window-fits")
    found = W.errors(rows, fitted.where(F.col("year").isin(inner)), columns, target, grid)
    alpha = W.choose(found, outer, grid, default, gates.inner_train, gates.inner_valid)
    best = F.filter("models", lambda m: m["alpha"] == F.col("alpha"))[0]
    return fitted.join(alpha, ["model_group", "year"]).select("model_group", "year", "train_rows", "shift", "alpha", best.alias("model"))


def rolling_ridge(rows: DataFrame, years: list[int], columns: W.Predictors, target: str, prior: str | None, gates: Gates = ROLLING,
                  flags: bool = True, grid: tuple[float, ...] = C.RIDGE_GRID, default: float = C.RIDGE_DEFAULT) -> DataFrame:
    """Predictions of holdout rows of evaluated folds with both baselines.

    For each outer year the penalty is chosen on all earlier seasons of the data. ``columns`` are predictors of all groups
    or of each group by name. Fits come from sums over seasons (``windows``): no row is copied for a fold or a penalty.
    """
    rows = materialize(rows, "fold-rows")
    folded = folds(rows, years)
    status = fold_status(folded, gates)
    held = baselines(folded, status, target, prior)
    outer = status.where("status = 'evaluated'").select(F.col("model_group").cast("string"), F.col("holdout_year").cast("int").alias("year"))
    outer = materialize(outer, "evaluated")
    inner = [y for y in seasons_of(rows) if y < max(years)]
    fit = _chosen_by_windows(rows, inner, outer, years, columns, target, gates, flags, grid, default)
    fit = fit.select(F.col("model_group"), F.col("year").alias("holdout_year"), "shift", "alpha", "model")
    hold = held.withColumn("_x", W.vector(columns)).join(fit, ["holdout_year", "model_group"])
    prediction = W.predict(F.col("_x"), F.col("shift"), F.col("model"), W.width(columns))
    return hold.select("entry_key", "holdout_year", "model_group", target, "historical_mean", "returning", "alpha", prediction.alias("prediction"))


def _choose_alpha_prepared(past: DataFrame, years: list[int], columns: W.Predictors, target: str, gates: Gates, flags: bool, grid: tuple[float, ...],
                           default: float, keys: tuple[str, ...], prepare: Prepare) -> DataFrame:
    """The penalty of lowest pooled MAE over expanding inner years, per key; the default where no inner year qualifies."""
    inner = folds(past, years)
    group = [*keys, "holdout_year"]
    counts = inner.groupBy(*group).agg(
        F.sum((F.col("part") == "train").cast("long")).alias("t"), F.sum((F.col("part") == "holdout").cast("long")).alias("v")
    )
    good = counts.where((F.col("t") >= gates.inner_train) & (F.col("v") >= gates.inner_valid)).select(*group)
    inner = inner.join(good, group, "left_semi")
    # Folds and vectors are written: the statistics, the fits and the scores each read them again.
    inner = materialize(prepare(inner, group), "inner-folds")
    inner = materialize(_vectors(inner, group, columns, flags).select(*group, "part", "x", target), "inner-vectors")
    tried = inner.where("part = 'train'").withColumn("_try", F.explode(F.array(*[F.lit(a) for a in grid])))
    beta = models.fit_ridge(tried, group, "x", target, F.col("_try"), _size(columns, flags))
    scored = inner.where("part = 'holdout'").join(beta, group)
    error = F.abs(models.dot(F.col("x"), F.col("beta")) - F.col(target))
    pooled = scored.groupBy(*keys, "alpha").agg(F.avg(error).alias("mae"))
    best = M.best_of_grid(pooled, list(keys), "alpha", "mae")
    everyone = past.select(*keys).distinct()
    return everyone.join(best, list(keys), "left").withColumn("alpha", F.coalesce("alpha", F.lit(default)))


def rolling_ridge_prepared(rows: DataFrame, years: list[int], columns: W.Predictors, target: str, prior: str | None, prepare: Prepare, gates: Gates = ROLLING,
                           flags: bool = True, grid: tuple[float, ...] = C.RIDGE_GRID, default: float = C.RIDGE_DEFAULT) -> DataFrame:
    """As ``rolling_ridge``, for predictors that ``prepare`` learns from every fold's training rows anew, inner folds
    included. Such predictors differ from fold to fold, so here folds are rows."""
    rows = materialize(rows, "fold-rows")
    folded = folds(rows, years)
    status = fold_status(folded, gates)
    held = baselines(folded, status, target, prior)
    good = status.where("status = 'evaluated'").select("holdout_year", "model_group")
    folded = folded.join(good, ["holdout_year", "model_group"], "left_semi")
    outer = ["holdout_year", "model_group"]
    past = folded.where("part = 'train'").withColumnRenamed("holdout_year", "outer_year").drop("part")
    seasons = [y for y in seasons_of(rows) if y < max(years)]
    alpha = _choose_alpha_prepared(past, seasons, columns, target, gates, flags, grid, default, ("outer_year", "model_group"), prepare)
    alpha = alpha.select(F.col("outer_year").alias("holdout_year"), "model_group", "alpha")
    folded = materialize(prepare(folded, outer), "folds")
    vectors = materialize(_vectors(folded, outer, columns, flags).select("entry_key", *outer, "part", "x", target), "vectors")
    alpha = materialize(alpha, "alpha")
    train = vectors.where("part = 'train'").join(alpha.withColumnRenamed("alpha", "_try"), outer)
    beta = models.fit_ridge(train, outer, "x", target, F.col("_try"), _size(columns, flags))
    hold = vectors.where("part = 'holdout'").join(beta, outer)
    hold = hold.select("entry_key", *outer, "alpha", models.dot(F.col("x"), F.col("beta")).alias("prediction"))
    return held.select("entry_key", *outer, target, "historical_mean", "returning").join(hold, ["entry_key", *outer])


def evaluate(predictions: DataFrame, target: str) -> DataFrame:
    """Errors and skills per fold, on all rows against the mean and on paired rows against the prior value."""
    e = F.abs(F.col("prediction") - F.col(target))
    paired = F.col("returning").isNotNull()
    t = predictions.groupBy("holdout_year", "model_group").agg(
        F.count("*").alias("n"),
        F.avg(e).alias("model_mae"),
        F.avg(F.abs(F.col("historical_mean") - F.col(target))).alias("historical_mae"),
        F.sum(paired.cast("long")).alias("paired_n"),
        F.avg(F.when(paired, e)).alias("paired_model_mae"),
        F.avg(F.abs(F.col("returning") - F.col(target))).alias("returning_mae"),
    )
    return t.withColumns(
        {
            "skill_vs_mean": M.skill(F.col("model_mae"), F.col("historical_mae")),
            "skill_vs_returning": M.skill(F.col("paired_model_mae"), F.col("returning_mae")),
        }
    )


def negative_control(panel: DataFrame, year: int, columns: W.Predictors, key: str, target: str = "prior_change", gates: Gates = CONTROL,
                     grid: tuple[float, ...] = C.RIDGE_GRID) -> tuple[DataFrame, DataFrame]:
    """Whether what is only known later predicts a change that came before: predictions and one row per group.

    ``panel`` has the kept rows of ``cohorts.negative_control``. Predictors are ``signal``, the mean change of the rows of the
    same ``key`` (encoded from each fold's training rows alone, inner folds included), and ``columns``, of all groups or of
    each group by name (a group that isn't named has only the signal). A group shows a signal if the model's error is below that of the training mean and its R2 above 0; skipped groups stay, without figures.
    """

    def encode(folded: DataFrame, by: list[str]) -> DataFrame:
        return M.encode_in_folds(folded, by, key, target)

    outer = ["holdout_year", "model_group"]
    if isinstance(columns, dict):
        groups = [r[0] for r in panel.select(F.col("model_group").cast("string")).where("model_group is not null").distinct().collect()]
        columns = {g: ["signal", *columns.get(g, ())] for g in groups}
    else:
        columns = ["signal", *columns]
    panel = materialize(panel, "panel")
    predictions = rolling_ridge_prepared(panel, [year], columns, target, None, encode, gates, flags=False, grid=grid, default=min(grid))
    predictions = materialize(predictions.drop("returning"), "control")
    model = M.regression(predictions, outer, target, "prediction")
    mean = M.regression(predictions, outer, target, "historical_mean").select(*outer, F.col("mae").alias("baseline_mae"))
    alpha = predictions.select(*outer, "alpha").distinct()
    result = fold_status(folds(panel, [year]), gates).join(model.join(mean, outer).join(alpha, outer), outer, "left")
    found = F.when(F.col("status") == "evaluated", (F.col("mae") < F.col("baseline_mae")) & (F.coalesce("r2", F.lit(0.0)) > 0))
    return predictions, result.withColumns({"mae_skill": M.skill(F.col("mae"), F.col("baseline_mae")), "signal_detected": found})


def _brier(odds: Column, y: Column) -> Column:
    p = M.clamp(1 / (1 + F.exp(-odds)))
    return (p - y) * (p - y)


def rolling_logistic(rows: DataFrame, years: list[int], columns: W.Predictors, label: str, gates: Gates = OBSERVABILITY,
                     grid: tuple[float, ...] = C.LOGIT_GRID, default: float = C.LOGIT_DEFAULT) -> DataFrame:
    """Probabilities of holdout rows of evaluated folds with the training prevalence; the penalty of lowest pooled Brier
    score on expanding inner years of the training part, the default where none qualifies. ``columns`` are predictors of all
    groups or of each group by name. Labels must be there; a fold of one class has no model.

    A window's fits serve as an inner and as an outer fold alike: all take their Newton steps together (``windows``).
    """
    rows = materialize(rows, "fold-rows")
    status = fold_status(folds(rows, years), gates, label)
    outer = status.where("status = 'evaluated'").select(F.col("model_group").cast("string"), F.col("holdout_year").cast("int").alias("year"))
    outer = materialize(outer, "evaluated")
    inner = [y for y in seasons_of(rows) if y < max(years)]
    tried = (*grid, *(() if default in grid else (default,)))
    fitted = materialize(W.fit_logistic(rows, sorted({*inner, *years}), columns, label, tried), "window-logits")
    enough = (F.col("train_positives") >= gates.inner_class) & (F.col("train_rows") - F.col("train_positives") >= gates.inner_class)
    found = W.errors(rows, fitted.where(F.col("year").isin(inner) & enough), columns, label, grid, _brier)
    alpha = W.choose(found, outer, grid, default, gates.inner_train, gates.inner_valid)
    best = F.filter("models", lambda m: m["alpha"] == F.col("alpha"))[0]
    fit = fitted.join(alpha, ["model_group", "year"]).select(
        "model_group", F.col("year").alias("holdout_year"), "shift", F.col("alpha").alias("l2"), best.alias("model"), (F.col("train_positives") / F.col("train_rows")).alias("prevalence")
    )
    hold = folds(rows, years).where("part = 'holdout'").withColumn("_x", W.vector(columns)).join(fit, ["holdout_year", "model_group"])
    odds = W.predict(F.col("_x"), F.col("shift"), F.col("model"), W.width(columns))
    return hold.select("entry_key", "holdout_year", "model_group", label, "l2", "prevalence", M.clamp(1 / (1 + F.exp(-odds))).alias("probability"))


def evaluate_probabilities(rows: DataFrame, predictions: DataFrame, years: list[int], label: str, gates: Gates = OBSERVABILITY) -> DataFrame:
    """One row per fold and group: status, counts, all probability metrics of the model, the Brier score of the training
    prevalence and the skill against it. Skipped folds stay, without figures."""
    outer = ["holdout_year", "model_group"]
    predictions = materialize(predictions, "probabilities")
    both = M.bundle(predictions, outer, label, "probability", "entry_key").drop("n", "positives")
    plain = M.probability(predictions, outer, label, "prevalence").select(*outer, F.col("brier").alias("baseline_brier"), F.col("log_loss").alias("baseline_log_loss"))
    chosen = predictions.select(*outer, "l2", F.col("prevalence").alias("train_prevalence")).distinct()
    t = fold_status(folds(rows, years), gates, label).join(both.join(plain, outer).join(chosen, outer), outer, "left")
    return t.withColumns({"brier_skill": M.skill(F.col("brier"), F.col("baseline_brier")), "beats_prevalence": F.col("brier") < F.col("baseline_brier")})


def pooled_probabilities(predictions: DataFrame, label: str) -> DataFrame:
    """All probability metrics over the predictions of all folds together: a row for the model, one for the prevalence."""
    predictions = materialize(predictions, "probabilities")
    rows = [M.bundle(predictions, [], label, c, "entry_key").select(F.lit(n).alias("forecast"), "*") for n, c in (("model", "probability"), ("prevalence", "prevalence"))]
    return rows[0].unionByName(rows[1])


def final_fit(train: DataFrame, score: DataFrame, years: list[int], columns: W.Predictors, target: str, gates: Gates = ROLLING,
              grid: tuple[float, ...] = C.RIDGE_GRID, default: float = C.RIDGE_DEFAULT) -> DataFrame:
    """Fit each group on all training rows, with a penalty chosen on expanding years, and score other rows; groups without
    training rows are absent. ``columns`` are predictors of all groups or of each group by name."""
    train = materialize(train, "final-train")
    last = max([*seasons_of(train), *years], default=0) + 1
    outer = train.select(F.col("model_group").cast("string")).distinct().withColumn("year", F.lit(last))
    fit = _chosen_by_windows(train, years, outer, [last], columns, target, gates, True, grid, default)
    fit = fit.select("model_group", "train_rows", "shift", "alpha", "model")
    rows = score.withColumn("_x", W.vector(columns)).join(fit, "model_group")
    prediction = W.predict(F.col("_x"), F.col("shift"), F.col("model"), W.width(columns))
    return rows.select("entry_key", "season", "model_group", "alpha", "train_rows", prediction.alias("prediction"))
