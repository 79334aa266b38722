"""Ridge and logistic models per group and fold.

A fold's model depends on its training rows only through the Gram matrix (ridge) or through a handful of Newton steps
(logistic). Both therefore aggregate in Spark, with partial sums before the shuffle, and solve small systems: ridge once, in
an Arrow function, the logistic fit once for each step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PROBABILITY_FLOOR
from ..sources.scratch import materialize


#: Numbers that the state of all groups of a fit may have; it comes to the driver and goes back to each task.
MAX_STATE = 1 << 22


def vector(columns: list[str], flags: bool) -> Column:
    """[1, z1, miss1, z2, ...] of preprocessed columns; without flags [1, z1, z2, ...]."""
    parts = [F.lit(1.0)]
    for c in columns:
        parts.append(F.col(f"z_{c}"))
        if flags:
            parts.append(F.col(f"miss_{c}").cast("double"))
    return F.array(*parts)


def ridge_solve(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients with an unpenalised intercept in front; singular systems are an error."""
    penalty = np.eye(len(xy)) * alpha
    penalty[0, 0] = 0.0
    return np.linalg.solve(xx + penalty, xy)


def fit_ridge(rows: DataFrame, by: list[str], x: str, y: str, alpha: float | Column, size: int | None = None) -> DataFrame:
    """``beta`` per group from summed moments, half of the square. ``x`` is an array column, of one length in a group, at most
    ``size`` (found by a job where it isn't told); ``alpha`` a number or a column of the group."""
    p = size if size is not None else rows.agg(F.max(F.size(x))).first()[0] or 1
    # Columns of the half square by their larger index, so that shorter vectors use the first ones.
    xx = [F.sum(F.get(x, F.lit(i)) * F.get(x, F.lit(j))) for j in range(p) for i in range(j + 1)]
    xy = [F.sum(F.get(x, F.lit(i)) * F.col(y)) for i in range(p)]
    group = [*by, "_alpha"]
    t = rows.withColumn("_alpha", F.lit(alpha) if not isinstance(alpha, Column) else alpha)
    t = t.groupBy(*group).agg(F.count("*").alias("train_rows"), F.max(F.size(x)).alias("_p"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"))

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series, alpha_: pd.Series, size_: pd.Series) -> pd.Series:
        out = []
        for m, v, r, n in zip(a, b, alpha_, size_, strict=True):
            lower = np.zeros((n, n))
            lower[np.tril_indices(n)] = m[: n * (n + 1) // 2]
            out.append(ridge_solve(lower + np.tril(lower, -1).T, np.asarray(v[:n], dtype=np.float64), float(r)).tolist())
        return pd.Series(out)

    return t.select(*by, F.col("_alpha").alias("alpha"), "train_rows", solve("xx", "xy", "_alpha", "_p").alias("beta"))


def dot(x: Column, beta: Column) -> Column:
    """The linear predictor, in the JVM."""
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def probability_of(odds: np.ndarray) -> np.ndarray:
    """Probabilities of log-odds, kept from 0 and 1."""
    return np.clip(1 / (1 + np.exp(-np.clip(odds, -700, 700))), PROBABILITY_FLOOR, 1 - PROBABILITY_FLOOR)


def logistic_newton(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 50, tol: float = 1e-7) -> np.ndarray:
    """Penalised maximum likelihood by Newton steps, intercept (column 0) unpenalised; a single class is an error."""
    if y.min() == y.max():
        raise ValueError("a logistic model needs both classes")
    penalty = np.full(x.shape[1], float(l2))
    penalty[0] = 0.0
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability_of(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta


def _moments(rows: DataFrame, by: list[str], x: str, y: str, p: int) -> DataFrame:
    """Sums of p(1-p)xx' (upper half) and x(y-p) per group, at the group's ``_beta``."""
    q = F.least(F.lit(1 - PROBABILITY_FLOOR), F.greatest(F.lit(PROBABILITY_FLOOR), 1 / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), dot(F.col(x), F.col("_beta"))))))))
    t = rows.withColumn("_q", q).withColumns({"_w": F.col("_q") * (1 - F.col("_q")), "_r": F.col(y).cast("double") - F.col("_q")})
    xx = [F.sum(F.col("_w") * F.col(x)[i] * F.col(x)[j]) for i in range(p) for j in range(i, p)]
    return t.groupBy(*by).agg(F.array(*xx).alias("xx"), F.array(*[F.sum(F.col("_r") * F.col(x)[i]) for i in range(p)]).alias("xr"))


def _newton(rows: DataFrame, state: list[dict], by: list[str], x: str, y: str, steps: int, tol: float) -> list[dict]:
    """Newton steps for all groups at once: a step is one aggregation and a small system for each group.

    ``state`` has a row per group with its key, ``beta`` and ``l2``; only groups that still move are read again. A group
    without a finite solution gets ``beta`` None if its ``l2`` is None and is an error otherwise.
    """
    spark = rows.sparkSession
    if not state:
        return state
    size = len(state[0]["beta"])
    if len(state) * size * size > MAX_STATE:
        raise ValueError(f"{len(state)} groups are too many fits for one state: fit them in parts")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    upper = np.triu_indices(size)
    live = {tuple(s[c] for c in by): s for s in state}
    for _ in range(steps):
        if not live:
            break
        now = spark.createDataFrame([(*k, [float(v) for v in s["beta"]]) for k, s in live.items()], f"{', '.join(f'_k_{k}' for k in kinds.split(', '))}, _beta array<double>")
        # Nulls are a group of their own, as in groupBy.
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        for r in _moments(rows.join(F.broadcast(now), same), by, x, y, size).collect():
            key = tuple(r[c] for c in by)
            s = live[key]
            m = np.zeros((size, size))
            m[upper] = r.xx
            m = m + np.triu(m, 1).T
            penalty = np.full(size, float(s["l2"] or 0.0))
            penalty[0] = 0.0
            try:
                step = np.linalg.solve(m + np.diag(penalty), np.asarray(r.xr) - penalty * s["beta"])
                s["beta"] = s["beta"] + step
                lost = not np.isfinite(s["beta"]).all()
            except np.linalg.LinAlgError:
                if s["l2"] is not None:
                    raise
                lost = True
            if lost and s["l2"] is None:
                s["beta"] = None
            if lost or np.abs(step).max() < tol:
                del live[key]
    return state


def fit_logistic(rows: DataFrame, by: list[str], x: str, y: str, l2: str, steps: int = 50, tol: float = 1e-7) -> DataFrame:
    """``beta`` per group; ``l2`` is a column that is constant in a group. Groups of one class get no model.

    The rows stay where they are; per Newton step and group one small matrix comes to the driver, however many rows.
    """
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", train_rows long, beta array<double>"
    rows, t = materialize(rows.select(*by, x, y, l2), "logistic"), F.col(y).cast("double")
    groups = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.first(l2).alias("_l2"), F.max(F.size(x)).alias("_p"))
    groups = groups.where("_lo < _hi").collect()
    state = [{**{c: g[c] for c in by}, "n": g["_n"], "l2": float(g["_l2"]), "beta": np.zeros(g["_p"])} for g in groups]
    _newton(rows.select(*by, x, y), state, by, x, y, steps, tol)
    return rows.sparkSession.createDataFrame([(*(s[c] for c in by), s["n"], s["beta"].tolist()) for s in state], schema)


def calibration_fit(logit: np.ndarray, y: np.ndarray, steps: int = 40, tol: float = 1e-9) -> tuple[float | None, float | None]:
    """Intercept and slope of the outcome on the logit; None for one class, constant logits or no finite solution."""
    if not len(y) or y.min() == y.max() or np.ptp(logit) < 1e-12:
        return None, None
    x, beta = np.column_stack([np.ones(len(y)), logit]), np.array([0.0, 1.0])
    for _ in range(steps):
        p = probability_of(x @ beta)
        try:
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        except np.linalg.LinAlgError:
            return None, None
        beta = beta + step
        if not np.isfinite(beta).all():
            return None, None
        if np.abs(step).max() < tol:
            break
    return float(beta[0]), float(beta[1])


def calibration(rows: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """Calibration intercept and slope per group: ``calibration_fit`` by aggregations, so a group of any size is spread."""
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by) + ", n long, intercept double, slope double"
    q = F.least(F.lit(1 - PROBABILITY_FLOOR), F.greatest(F.lit(PROBABILITY_FLOOR), F.col(p).cast("double")))
    t = rows.withColumn("_z", F.log(q / (1 - q))).select(*by, F.col(label).cast("double").alias("_y"), F.array(F.lit(1.0), "_z").alias("_x"))
    t, z = materialize(t, "calibration"), F.col("_x")[1]
    groups = t.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"), (F.max(z) - F.min(z)).alias("_ptp")).collect()
    state = [{**{c: g[c] for c in by}, "l2": None, "beta": np.array([0.0, 1.0])} for g in groups if g["_lo"] < g["_hi"] and g["_ptp"] >= 1e-12]
    fitted = {tuple(s[c] for c in by): s["beta"] for s in _newton(t, state, by, "_x", "_y", 40, 1e-9)}
    out = []
    for g in groups:
        key = tuple(g[c] for c in by)
        beta = fitted.get(key)
        out.append((*key, g["_n"], *((None, None) if beta is None else (float(beta[0]), float(beta[1])))))
    return rows.sparkSession.createDataFrame(out, schema)
