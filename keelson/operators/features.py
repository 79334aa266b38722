"""Long statistics to wide features; missing stays missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import feature_name, strict_number


def named_values(stats: DataFrame) -> DataFrame:
    """``entry_key``, ``feature`` (phase, category, statistic) and numeric ``value`` of long rows."""
    return stats.select(
        "entry_key", feature_name(F.col("phase"), F.col("category"), F.col("stat_type")).alias("feature"), strict_number(F.col("stat")).alias("value")
    )


def conflicts(values: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Keys that have several different values; equal duplicates are no conflict. Min and max suffice and combine early."""
    t = values.groupBy(*key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
    return t.where(F.col("least") != F.col("most"))


def pivot(values: DataFrame, key: str, features: list[str], fail: bool = True) -> DataFrame:
    """One row per key, one column per feature (given, so that no job is spent on finding them); null where absent.

    With ``fail``, different values for a key and a feature, listed or not, are an error when a column is read. All listed
    features of a key are one row of the first aggregation, so they are combined before its shuffle; others have rows of
    their own, of which only the check is needed.
    """
    if not fail:
        return values.groupBy(key).pivot("feature", features).agg(F.max("value"))
    listed = F.coalesce(F.col("feature").isin(features), F.lit(False))
    named = F.when(~listed, F.coalesce("feature", F.lit("")))
    each = [F.when(F.col("feature") == f, F.col("value")) for f in features] + [F.when(~listed, F.col("value"))]
    t = values.groupBy(key, named.alias("_other")).agg(*[g(c).alias(f"_{n}_{i}") for i, c in enumerate(each) for n, g in (("low", F.min), ("high", F.max))])
    clash = F.coalesce(*[F.when(F.col(f"_low_{i}") != F.col(f"_high_{i}"), name) for i, name in enumerate([*map(F.lit, features), F.col("_other")])])
    t = t.withColumn("_clash", clash)
    error = F.raise_error(F.concat_ws(" ", F.lit("conflicting values for"), F.col(key).cast("string"), F.col("_clash"))).cast("double")
    value = lambda i: F.when(F.col("_clash").isNotNull(), error).otherwise(F.col(f"_high_{i}"))
    return t.groupBy(key).agg(*[F.max(value(i)).alias(f) for i, f in enumerate(features)])


def matrix(bridge: DataFrame, values: DataFrame, features: list[str], key: str = "entry_key") -> DataFrame:
    """Every bridge row with its features (null where none), ``has_features`` (whether its key has any value at all) and the
    eligibility flag of a complete pair."""
    wide = pivot(values, key, features).withColumn("_any", F.lit(True))
    eligible = F.col("complete_pre_post") & ~F.col("post_outcome_right_censored")
    rows = bridge.join(wide, key, "left").withColumn("has_features", F.coalesce("_any", F.lit(False))).drop("_any")
    return rows.withColumn("eligible", eligible)


def orphans(values: DataFrame, bridge: DataFrame, key: str = "entry_key") -> DataFrame:
    """Values whose key the bridge doesn't have; must be empty before a matrix is published."""
    return values.join(bridge.select(key), key, "left_anti")


def with_missing_flags(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``missing_<c>`` for each column and the numbers of observed and missing ones."""
    flags = {f"missing_{c}": F.col(c).isNull() for c in columns}
    gone = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return rows.withColumns(flags).withColumns({"feature_missing_count": gone, "feature_observed_count": F.lit(len(columns)) - gone})


def prefixed(rows: DataFrame, prefix: str, without: tuple[str, ...] = ()) -> list[str]:
    return [c for c in rows.columns if c.startswith(prefix) and c not in without]
