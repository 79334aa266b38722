"""Ridge and logistic models over expanding windows of seasons: no row is copied for a window.

A row gives [1, v, m]: its values less a shift of the group (0 where missing) and flags of what is missing. Their products
are summed per group and season. Whatever a window needs follows from the sum of its seasons: imputing its medians and
scaling are linear maps of these products. So rows are read once for the sums, however many windows, inner windows and
penalties there are, and never copied. Each group may have predictors of its own: its vectors have its own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .medians import expanding_medians
from .models import probability_of, ridge_solve

#: Predictors of all groups alike, or of each group by name.
Predictors = list[str] | dict[str, tuple[str, ...]] | dict[str, list[str]]

_KEPT = 4096  #: groups and seasons whose sums a task holds before it passes them on


def names(columns: Predictors) -> list[str]:
    """All predictors, each once."""
    return list(dict.fromkeys(c for group in columns.values() for c in group)) if isinstance(columns, dict) else list(columns)


def width(columns: Predictors) -> int:
    """The most predictors of a group."""
    return max((len(c) for c in columns.values()), default=0) if isinstance(columns, dict) else len(columns)


def vector(columns: Predictors, group: str = "model_group") -> Column:
    """A row's own predictors in order, as an array; null where missing. Groups that aren't named have none."""
    if not isinstance(columns, dict):
        return F.array(*[F.col(c).cast("double") for c in columns])
    out = F.array().cast("array<double>")
    for g, mine in columns.items():
        out = F.when(F.col(group) == g, F.array(*[F.col(c).cast("double") for c in mine])).otherwise(out)
    return out


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of each group and season of the partition; one row for each, or several if there are many."""
    sums: dict[tuple, list] = {}

    def flush() -> pa.RecordBatch:
        keys = list(sums)
        half = [s[1][np.triu_indices(len(s[1]))] for s in sums.values()]
        nothing = lambda x: np.where(np.isfinite(x), x, np.nan)
        out = pa.record_batch(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()),
                pa.array([h.tolist() for h in half], pa.list_(pa.float64())),
                pa.array([nothing(s[2]).tolist() for s in sums.values()], pa.list_(pa.float64())),
                pa.array([nothing(s[3]).tolist() for s in sums.values()], pa.list_(pa.float64())),
            ],
            names=["model_group", "season", "n", "products", "low", "high"],
        )
        sums.clear()
        return out

    for batch in batches:
        group, season = batch.column(0).to_pandas(), batch.column(1).to_numpy(zero_copy_only=False)
        y = batch.column(4).to_numpy(zero_copy_only=False)
        for key, at in pd.Series(np.arange(batch.num_rows)).groupby([group.to_numpy(), season]).indices.items():
            take = pa.array(at)
            x, shift = (c.reshape(len(at), len(c) // len(at)) for c in (batch.column(k).take(take).flatten().to_numpy(zero_copy_only=False) for k in (2, 3)))
            gone = np.isnan(x)
            v = np.where(gone, 0.0, x - shift)
            # The target stands last.
            w = np.column_stack([np.ones(len(at)), v, gone, y[at]])
            low, high = (f(np.where(gone, e, v), axis=0, initial=e) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
            if key in sums:
                s = sums[key]
                sums[key] = [s[0] + len(at), s[1] + w.T @ w, np.minimum(s[2], low), np.maximum(s[3], high)]
            else:
                sums[key] = [len(at), w.T @ w, low, high]
        if len(sums) > _KEPT:
            yield flush()
    yield flush()


def moments(rows: DataFrame, shifts: DataFrame, columns: Predictors, target: str) -> DataFrame:
    """One row per group and season: ``n``, the upper half of the summed products of [1, v, m, target] and the least and
    largest v of each predictor. ``shifts`` has ``model_group`` and an array ``shift``."""
    k = width(columns)
    t = rows.select("model_group", "season", vector(columns).alias("x"), F.col(target).cast("double").alias("y")).join(shifts, "model_group")
    t = t.select(F.col("model_group").cast("string"), F.col("season").cast("int"), "x", F.slice("shift", F.lit(1), F.size("x")).alias("shift"), "y")
    parts = t.mapInArrow(_products, "model_group string, season int, n long, products array<double>, low array<double>, high array<double>")
    real = lambda c, i: F.when(~F.isnan(F.get(c, F.lit(i))), F.get(c, F.lit(i)))
    size = (2 * k + 2) * (2 * k + 3) // 2
    return parts.groupBy("model_group", "season").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.get("products", F.lit(i))) for i in range(size)]).alias("products"),
        F.array(*[F.min(real("low", i)) for i in range(k)]).alias("low"),
        F.array(*[F.max(real("high", i)) for i in range(k)]).alias("high"),
    )


def scaling(n: int, total: np.ndarray, low: np.ndarray, high: np.ndarray, middle: np.ndarray, flags: bool) -> tuple[np.ndarray, ...]:
    """The linear map from [1, v, m, target] to a window's imputed and scaled predictors [1, z, ...], and their means,
    deviations and whether they stay the same."""
    k = len(middle)
    one, v, m = total[0], np.arange(1, k + 1), np.arange(k + 1, 2 * k + 1)
    mean = (one[v] + middle * one[m]) / n
    square = (total[v, v] + middle**2 * one[m]) / n - mean**2
    # Told by the values, as sums of equal values may not cancel.
    sd = np.where((low < high) & (square >= 1e-24), np.sqrt(np.maximum(square, 1e-24)), 1.0)
    mean = np.where(low < high, mean, middle)
    to = np.zeros((1 + k * (2 if flags else 1), 2 * k + 2))
    to[0, 0] = 1
    z = 1 + np.arange(k) * (2 if flags else 1)
    to[z, v], to[z, m], to[z, 0] = 1 / sd, middle / sd, -mean / sd
    if flags:
        to[z + 1, m] = 1
    still = ~(low < high)
    to[z[still]] = 0
    return to, mean, sd, still


def unscaled(alpha: float, beta: np.ndarray, mean: np.ndarray, sd: np.ndarray, still: np.ndarray, middle: np.ndarray, flags: bool) -> dict:
    """A fit in terms of v: ``base`` plus ``slope`` times v where a predictor is there and ``missing`` where it isn't."""
    z = 1 + np.arange(len(middle)) * (2 if flags else 1)
    slope = np.where(still, 0.0, beta[z] / sd)
    extra = beta[z + 1] if flags else np.zeros(len(middle))
    return {"alpha": alpha, "base": float(beta[0] - slope @ mean), "slope": slope.tolist(), "missing": (slope * middle + extra).tolist()}


def _window(n: int, total: np.ndarray, low: np.ndarray, high: np.ndarray, middle: np.ndarray, flags: bool, grid: tuple[float, ...]) -> list[dict]:
    """The fits of one window from its sums, for each penalty. ``middle`` has the shifted medians."""
    to, mean, sd, still = scaling(n, total, low, high, middle, flags)
    xx, xy = to @ total @ to.T, to @ total[:, -1]
    return [unscaled(alpha, ridge_solve(xx, xy, alpha), mean, sd, still, middle, flags) for alpha in grid]


_MODELS = "array<struct<alpha:double,base:double,slope:array<double>,missing:array<double>>>"


def gathered(rows: DataFrame, years: list[int], columns: Predictors, target: str) -> tuple[DataFrame, DataFrame]:
    """One row per group with the sums of its seasons, its medians of each window, ``shift`` and the number of its own
    predictors; and the shifts of all groups as a written table."""
    k, last = width(columns), (1 << 31) - 1
    rows = rows.where("season is not null")
    values = vector(columns)
    wide = rows.withColumn("_x", values)
    middles = expanding_medians(wide, ["model_group"], [F.get("_x", F.lit(i)) for i in range(k)], "season", [*years, last]) if k else None
    groups = rows.select("model_group").distinct()
    nothing = F.array_repeat(F.lit(0.0), k).cast("array<double>")
    if middles is None:
        shifts = groups.withColumn("shift", nothing)
        per = groups.select("model_group", F.array().cast("array<struct<year:int,medians:array<double>>>").alias("middles"))
    else:
        middles = materialize(middles.withColumn("medians", F.transform("medians", lambda x: F.coalesce(x, F.lit(0.0)))), "window-medians")
        whole = middles.where(F.col("year") == last).select("model_group", F.col("medians").alias("shift"))
        shifts = groups.join(whole, "model_group", "left").withColumn("shift", F.coalesce("shift", nothing))
        per = middles.groupBy("model_group").agg(F.collect_list(F.struct("year", "medians")).alias("middles"))
    shifts = materialize(shifts, "window-shifts")
    sums = moments(rows, shifts, columns, target)
    sums = sums.groupBy("model_group").agg(F.collect_list(F.struct("season", "n", "products", "low", "high")).alias("sums"))
    together = sums.join(per, "model_group", "left").join(shifts, "model_group")
    size = F.lit(k)
    if isinstance(columns, dict):
        size = F.lit(0)
        for g, mine in columns.items():
            size = F.when(F.col("model_group") == g, F.lit(len(mine))).otherwise(size)
    return together.select("model_group", "sums", "middles", "shift", size.alias("size")), shifts


def expanding(row: dict, years: list[int]) -> Iterator[tuple]:
    """The windows of a row of ``gathered``, those without rows left out: year, rows, summed products, least and largest
    values and shifted medians."""
    p, shift = row["size"], np.array(row["shift"], dtype=np.float64)
    middle = {m["year"]: np.array(m["medians"]) for m in row["middles"] or []}
    side = 2 * p + 2
    real = lambda x, e: np.array([e if y is None else y for y in x[:p]], dtype=np.float64)
    n, total, low, high = 0, np.zeros((side, side)), np.full(p, np.inf), np.full(p, -np.inf)
    parts = sorted(row["sums"], key=lambda s: s["season"])
    for year in sorted(years):
        while parts and parts[0]["season"] < year:
            s = parts.pop(0)
            half = np.zeros((side, side))
            half[np.triu_indices(side)] = s["products"][: side * (side + 1) // 2]
            total, n = total + half + np.triu(half, 1).T, n + s["n"]
            low, high = np.minimum(low, real(s["low"], np.inf)), np.maximum(high, real(s["high"], -np.inf))
        if n:
            # Without any value in the window the median counts as 0.
            at = np.where(np.isfinite(low), middle.get(year, np.zeros(len(shift)))[:p], 0.0) - shift[:p]
            yield year, n, total, low, high, at


def fit(rows: DataFrame, years: list[int], columns: Predictors, target: str, grid: tuple[float, ...], flags: bool = True) -> DataFrame:
    """One row per group and year with rows of seasons before it: ``model_group``, ``year``, ``train_rows``, ``shift`` and
    ``models``, the fit of each penalty of ``grid`` on all seasons before that year.

    As of ``metrics.preprocess`` and ``models.fit_ridge``: exact medians of the window (0 where a predictor is always
    missing), population deviations (1 where nothing varies), flags of what is missing, an intercept that isn't penalised.
    Targets must be there. The rows are read for the medians, whose windows share all counts, and once for the sums; a
    group's sums of its seasons then meet in one row.
    """
    together, _ = gathered(rows, years, columns, target)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for year, n, total, low, high, at in expanding(row, years):
                    out.append((row["model_group"], year, n, row["shift"], _window(n, total, low, high, at, flags, grid)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, _FITTED, strict=True)], names=["model_group", "year", "train_rows", "shift", "models"])

    return together.mapInArrow(solve, f"model_group string, year int, train_rows long, shift array<double>, models {_MODELS}")


#: Numbers that the state of all fits of a step may have; it is held by the driver and by each task.
MAX_STATE = 1 << 22


def _newton_sums(fits: list[dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each of ``fits`` (``group``, ``year``, ``eta``: coefficients of [1, v, m]) the partition's sums of p(1-p)dd' and
    d(y-p) over the rows of the seasons before its year, d = [1, v, m]. A row serves all windows that hold it."""
    by_group: dict[str, list[int]] = {}
    for i, f in enumerate(fits):
        by_group.setdefault(f["group"], []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            group, season = batch.column(0).to_pandas(), batch.column(1).to_numpy(zero_copy_only=False)
            y = batch.column(3).to_numpy(zero_copy_only=False)
            for (g, s), at in pd.Series(np.arange(batch.num_rows)).groupby([group.to_numpy(), season]).indices.items():
                mine = [i for i in by_group.get(g, ()) if fits[i]["year"] > s]
                if not mine:
                    continue
                v = batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                gone = np.isnan(v)
                d = np.column_stack([np.ones(len(at)), np.where(gone, 0.0, v), gone])
                for i in mine:
                    p = probability_of(d @ fits[i]["eta"])
                    one = [(d * (p * (1 - p))[:, None]).T @ d, d.T @ (y[at] - p)]
                    sums[i] = [a + b for a, b in zip(sums[i], one, strict=True)] if i in sums else one
        half = [m[0][np.triu_indices(len(m[0]))].tolist() for m in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(half, _VECTOR), pa.array([m[1].tolist() for m in sums.values()], _VECTOR)], names=["i", "xx", "xr"])

    return run


def fit_logistic(rows: DataFrame, years: list[int], columns: Predictors, label: str, grid: tuple[float, ...], steps: int = 50, tol: float = 1e-7) -> DataFrame:
    """As ``fit`` for a 0/1 label: one row per group and year whose seasons before it have both classes, ``train_positives``
    among its columns; ``predict`` gives the log-odds.

    The fits of all groups, windows and penalties take their Newton steps together: a step reads the rows once, and no row
    is copied for a window or a penalty. The state of the fits is small and bounded (``MAX_STATE``): more is an error.
    """
    spark = rows.sparkSession
    k = width(columns)
    together, shifts = gathered(rows, years, columns, label)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for year, n, total, low, high, at in expanding(row, years):
                    to, mean, sd, still = scaling(n, total, low, high, at, True)
                    out.append((row["model_group"], year, n, round(total[0, -1]), row["shift"], to[:, :-1].ravel().tolist(), mean.tolist(), sd.tolist(), still.tolist(), at.tolist()))
            cols = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), _VECTOR, _VECTOR, _VECTOR, _VECTOR, pa.list_(pa.bool_()), _VECTOR]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _SCALED.split(", ")])

    groups = shifts.count()
    if groups * len(years) * len(grid) * (2 * k + 1) ** 2 > MAX_STATE:
        raise ValueError(f"{groups} groups, {len(years)} windows and {len(grid)} penalties are too many fits for one state: fit the groups in parts")
    windows = together.mapInArrow(prepare, _SCALED).where("train_positives > 0 and train_positives < train_rows").collect()
    fits = []
    for w in windows:
        to = np.reshape(w["to"], (2 * len(w["mean"]) + 1, -1))
        fits += [{"window": w, "group": w["model_group"], "year": w["year"], "to": to, "alpha": a, "beta": np.zeros(len(to))} for a in grid]
    x = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.get("x", i) - F.get("shift", i))
    t = rows.where("season is not null").select("model_group", F.col("season").cast("int"), vector(columns).alias("x"), F.col(label).cast("double").alias("y"))
    t = t.join(shifts, "model_group").select(F.col("model_group").cast("string"), "season", F.when(F.size("x") > 0, x).otherwise(F.array().cast("array<double>")).alias("x"), "y")
    t = materialize(t, "logit-rows")
    live, size = list(range(len(fits))), (2 * k + 1) * (k + 1)
    for _ in range(steps if live else 0):
        now = [{"group": f["group"], "year": f["year"], "eta": f["to"].T @ f["beta"]} for f in (fits[i] for i in live)]
        parts = t.mapInArrow(_newton_sums(now), "i int, xx array<double>, xr array<double>")
        sums = parts.groupBy("i").agg(F.array(*[F.sum(F.get("xx", F.lit(j))) for j in range(size)]).alias("xx"), F.array(*[F.sum(F.get("xr", F.lit(j))) for j in range(2 * k + 1)]).alias("xr"))
        moving = []
        for r in sums.collect():
            f = fits[live[r.i]]
            to, beta = f["to"], f["beta"]
            side = to.shape[1]
            m = np.zeros((side, side))
            m[np.triu_indices(side)] = r.xx[: side * (side + 1) // 2]
            m = m + np.triu(m, 1).T
            penalty = np.full(len(beta), float(f["alpha"]))
            penalty[0] = 0.0
            step = np.linalg.solve(to @ m @ to.T + np.diag(penalty), to @ np.asarray(r.xr[:side]) - penalty * beta)
            f["beta"] = beta + step
            if np.abs(step).max() >= tol:
                moving.append(live[r.i])
        live = sorted(moving)
        if not live:
            break
    out = {}
    for f in fits:
        w = f["window"]
        model = unscaled(f["alpha"], f["beta"], np.array(w["mean"]), np.array(w["sd"]), np.array(w["still"], dtype=bool), np.array(w["middle"]), True)
        out.setdefault((w["model_group"], w["year"], w["train_rows"], w["train_positives"], tuple(w["shift"])), []).append(model)
    kept = [(*key[:4], list(key[4]), models) for key, models in out.items()]
    return spark.createDataFrame(kept, f"model_group string, year int, train_rows long, train_positives long, shift array<double>, models {_MODELS}")


_VECTOR = pa.list_(pa.float64())
_SCALED = (
    "model_group string, year int, train_rows long, train_positives long, shift array<double>, to array<double>, mean array<double>, sd array<double>, still array<boolean>, middle array<double>"
)
_MODEL = pa.struct([("alpha", pa.float64()), ("base", pa.float64()), ("slope", _VECTOR), ("missing", _VECTOR)])
_FITTED = (pa.string(), pa.int32(), pa.int64(), _VECTOR, pa.list_(_MODEL))


def predict(x: Column, shift: Column, model: Column, k: int) -> Column:
    """What a fit says of a row's vector."""
    out = model["base"]
    for i in range(k):
        at = F.lit(i)
        out = out + F.coalesce(F.get(model["slope"], at) * (F.get(x, at) - F.get(shift, at)), F.get(model["missing"], at), F.lit(0.0))
    return out


def distance(prediction: Column, y: Column) -> Column:
    return F.abs(prediction - y)


def errors(rows: DataFrame, fitted: DataFrame, columns: Predictors, target: str, grid: tuple[float, ...], loss: Callable[[Column, Column], Column] = distance) -> DataFrame:
    """For each group and year, rows of that season and the summed ``loss`` of each penalty's fit: ``valid_rows``, ``errors``
    (an array as of ``grid``, whose fits lead ``models``). A row is never copied: its errors are an array."""
    k = width(columns)
    t = rows.select("model_group", F.col("season").cast("int").alias("year"), vector(columns).alias("x"), F.col(target).cast("double").alias("y"))
    t = t.join(fitted.select("model_group", "year", "train_rows", "shift", "models"), ["model_group", "year"])
    off = F.transform("models", lambda m: loss(predict(F.col("x"), F.col("shift"), m, k), F.col("y")))
    t = t.select("model_group", "year", "train_rows", off.alias("off"))
    return t.groupBy("model_group", "year", "train_rows").agg(
        F.count("*").alias("valid_rows"), F.array(*[F.sum(F.get("off", F.lit(i))) for i in range(len(grid))]).alias("errors")
    )


def choose(found: DataFrame, outer: DataFrame, grid: tuple[float, ...], default: float, inner_train: int, inner_valid: int) -> DataFrame:
    """``alpha`` for each row of ``outer`` (``model_group``, ``year``): the penalty of lowest error, pooled over all earlier
    years of ``errors`` with enough rows; of equal errors the smaller penalty, without such years the default."""
    good = found.where((F.col("train_rows") >= inner_train) & (F.col("valid_rows") >= inner_valid))
    good = good.select(F.col("model_group").alias("_g"), F.col("year").alias("_inner"), "errors")
    t = outer.join(good, (F.col("model_group") == F.col("_g")) & (F.col("_inner") < F.col("year")), "left")
    t = t.groupBy("model_group", "year").agg(*[F.sum(F.get("errors", F.lit(i))).alias(f"_e{i}") for i in range(len(grid))])
    best = F.array_min(F.array(*[F.when(F.col(f"_e{i}").isNotNull(), F.struct(F.col(f"_e{i}").alias("e"), F.lit(a).alias("a"))) for i, a in enumerate(grid)]))
    return t.select("model_group", "year", F.coalesce(best["a"], F.lit(float(default))).alias("alpha"))
