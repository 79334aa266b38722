"""Errors, skill, probability metrics and ranks, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import PROBABILITY_FLOOR
from ..sources.scratch import materialize
from . import models
from .medians import medians


def regression(rows: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """n, MAE, RMSE and R2 per group; R2 is null where the actual values don't vary.

    The total sum of squares is taken around each group's mean in a second pass, as sums of squares would cancel.
    """
    means = rows.groupBy(*by).agg(F.avg(actual).alias("_mean"))
    error = F.col(predicted) - F.col(actual)
    t = rows.join(means, by).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_res"),
        F.sum((F.col(actual) - F.col("_mean")) * (F.col(actual) - F.col("_mean"))).alias("_tot"),
    )
    return t.withColumn("r2", F.when(F.col("_tot") > 1e-12, 1 - F.col("_res") / F.col("_tot"))).drop("_res", "_tot")


def skill(model: Column, baseline: Column) -> Column:
    """1 - model / baseline; null for a baseline of about 0."""
    return F.when(F.abs(baseline) > 1e-12, 1 - model / baseline)


def clamp(p: Column) -> Column:
    return F.least(F.lit(1 - PROBABILITY_FLOOR), F.greatest(F.lit(PROBABILITY_FLOOR), p))


def probability(rows: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """n, prevalence, Brier score and log loss (probabilities kept away from 0 and 1)."""
    q, y = clamp(F.col(p)), F.col(label).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(y).cast("long").alias("positives"),
        F.avg(y).alias("prevalence"),
        F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
    )


def running_sums(rows: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``_sum_<c>`` for each column of ``sums``: its sum over a group's rows up to and including this one.

    Rows are sorted into ranges, which are written; a range's sums start where the ranges before it end. So a group of
    any size is spread over tasks, and only one row per range and group meets in a window. Nulls are a group.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = materialize(rows.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "running")
    ends = t.groupBy("_range", *by).agg(*[F.sum(c).alias(f"_end_{c}") for c in sums])
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(f"_end_{c}").over(w), F.lit(0)).alias(f"_end_{c}") for c in sums])
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({f"_sum_{c}": F.sum(c).over(inside) for c in sums}).join(before, same)
    t = t.withColumns({f"_sum_{c}": F.col(f"_sum_{c}") + F.col(f"_end_{c}") for c in sums})
    return t.drop("_range", "_r", *[f"_by_{c}" for c in by], *[f"_end_{c}" for c in sums])


def roc_auc(rows: DataFrame, by: list[str], label: str, p: str) -> DataFrame:
    """Area under the ROC curve by average ranks; null where one class is missing.

    Rows are aggregated to one per different score first, so ties and common scores cost one row in the ranks.
    """
    t = rows.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    t = running_sums(t, by, [F.col(p)], ["n"]).withColumn("_rank", F.col("_sum_n") - F.col("n") + (F.col("n") + 1) / 2)
    t = t.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("n").alias("n"), F.sum(F.col("pos") * F.col("_rank")).alias("_r"))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    auc = F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / (pos * neg))
    return t.select(*by, "n", "positives", auc.alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str], label: str, p: str, ordinal: str) -> DataFrame:
    """Average precision over rows by descending score; equal scores keep the order of ``ordinal``; constant scores give the
    prevalence; null without positives."""
    t = rows.select(*by, p, ordinal, F.col(label).cast("long").alias("_y"), F.lit(1).cast("long").alias("_k"))
    t = running_sums(t, by, [F.col(p).desc(), F.col(ordinal)], ["_y", "_k"])
    t = t.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("_y").alias("positives"), F.min(p).alias("_lo"), F.max(p).alias("_hi"),
        F.sum(F.when(F.col("_y") == 1, F.col("_sum__y") / F.col("_sum__k"))).alias("_s"),
    )
    flat = F.col("positives") / F.col("n")
    ap = F.when(F.col("positives") == 0, None).when(F.col("_lo") == F.col("_hi"), flat).otherwise(F.col("_s") / F.col("positives"))
    return t.select(*by, "n", "positives", ap.alias("average_precision"))


def bundle(rows: DataFrame, by: list[str], label: str, p: str, ordinal: str) -> DataFrame:
    """All probability metrics per group: ``probability``, ``roc_auc``, ``average_precision`` and the calibration's
    ``intercept`` and ``slope``, of probabilities kept away from 0 and 1. Without ``by`` one row over all; no row for no rows.
    """
    keys = by or ["_all"]
    t = rows if by else rows.withColumn("_all", F.lit(1))
    t = materialize(t.select(*keys, ordinal, F.col(label).cast("int").alias("_label"), clamp(F.col(p)).alias("_p")), "scored")
    out = probability(t, keys, "_label", "_p")
    for other in (
        roc_auc(t, keys, "_label", "_p").select(*keys, "roc_auc"),
        average_precision(t, keys, "_label", "_p", ordinal).select(*keys, "average_precision"),
        models.calibration(t, keys, "_label", "_p").select(*keys, "intercept", "slope"),
    ):
        other = other.select(*[F.col(c).alias(f"_by_{c}") if c in keys else c for c in other.columns])
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        out = out.join(other, same, "left").drop(*[f"_by_{c}" for c in keys])
    return out if by else out.drop("_all")


def reliability(rows: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Mean probability and observed rate per bin of equal width; empty bins are kept, a probability of 1 is in the last."""
    spark = rows.sparkSession
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    t = rows.groupBy(bin_.alias("_b")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("observed"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(t, F.col("bin") == F.col("_b"), "left").select(
        "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "observed",
    )


def best_of_grid(rows: DataFrame, by: list[str], value: str, score: str) -> DataFrame:
    """The grid value of the lowest score per group; of equal scores the smaller value; null scores don't count."""
    return rows.where(F.col(score).isNotNull()).groupBy(*by).agg(F.min_by(value, F.struct(score, value)).alias(value), F.min(score).alias(score))


def wins(rows: DataFrame, by: list[str], model: str, baseline: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("folds"), F.sum((F.col(model) < F.col(baseline)).cast("long")).alias("wins"))


def preprocess(rows: DataFrame, train: DataFrame, by: list[str], columns: list[str], flags: bool = True) -> DataFrame:
    """Median-imputed, standardised features (and missing flags) from statistics of the training rows only.

    Medians are exact in groups of any size (``medians``), 0 where all are missing; deviations are of the population, 1
    where they vanish. Statistics are one row per group, joined to the rows.
    """
    # Written, as each round of the medians reads it.
    train = materialize(train.select(*by, *columns), "train")
    med = medians(train, by, columns)
    med = materialize(med.withColumns({f"_m_{c}": F.coalesce(f"_m_{c}", F.lit(0.0)) for c in columns}), "medians")
    full = train.join(med, by)
    stats = full.groupBy(*by).agg(
        *[F.avg(F.coalesce(c, f"_m_{c}")).alias(f"_a_{c}") for c in columns],
        *[F.stddev_pop(F.coalesce(c, f"_m_{c}")).alias(f"_s_{c}") for c in columns],
    )
    t = rows.join(med.join(stats, by), by)
    out = {}
    for c in columns:
        sd = F.when(F.col(f"_s_{c}") < 1e-12, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        out[f"z_{c}"] = (F.coalesce(F.col(c), F.col(f"_m_{c}")) - F.col(f"_a_{c}")) / sd
        if flags:
            out[f"miss_{c}"] = F.col(c).isNull().cast("int")
    t = t.withColumns(out)
    return t.drop(*[f"_{k}_{c}" for k in "mas" for c in columns])


def gram(rows: DataFrame, by: list[str], columns: list[str], target: str) -> DataFrame:
    """X'X (upper half) and X'y as sums, one row per group: partial sums before the shuffle, however many rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(F.col(a) * F.col(b)).alias(f"xx_{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(a) * F.col(target)).alias(f"xy_{a}") for a in columns],
        F.sum(target).alias("sum_y"),
    )


def target_encoding(rows: DataFrame, train: DataFrame, key: str, target: str) -> DataFrame:
    """The training mean of a row's key, or of all training rows for keys that training hasn't seen."""
    means = train.groupBy(key).agg(F.avg(target).alias("_mean"))
    whole = train.agg(F.avg(target).alias("_all")).withColumn("_one", F.lit(1))
    t = rows.join(means, key, "left").withColumn("_one", F.lit(1)).join(whole, "_one", "left")
    return t.withColumn("signal", F.coalesce("_mean", "_all")).drop("_mean", "_all", "_one")


def encode_in_folds(folded: DataFrame, by: list[str], key: str, target: str) -> DataFrame:
    """Adds ``signal``: the mean of a row's key among its group's training rows (``part`` train), or of all of these where
    the key is blank or training hasn't seen it. Keys match whatever their case and the blanks around them.

    Means are pre-aggregated per key, so a hot key is one row of the join. A group without training rows gets null.
    """
    named = folded.withColumn("_key", F.lower(F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))))
    # Rows without a value add nothing to a mean. Both readers of the sums read all of them, so their shuffle is one.
    train = named.where((F.col("part") == "train") & F.col(target).isNotNull())
    sums = train.groupBy(*by, "_key").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    means = sums.select(*by, "_key", F.when(F.col("_key") != "", F.col("_s") / F.col("_n")).alias("_mean"))
    whole = sums.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("_whole"))
    t = named.join(means, [*by, "_key"], "left").join(whole, by, "left")
    return t.withColumn("signal", F.coalesce("_mean", "_whole")).drop("_key", "_mean", "_whole")
