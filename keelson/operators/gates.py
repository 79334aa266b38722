"""Contracts that a table must keep before it is published. Each gate is one row of ``check``, ``ok``, ``found``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A contract is broken."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise GateError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, prefixes: tuple[str, ...], names: tuple[str, ...] = ()) -> DataFrame:
    if bad := [c for c in df.columns if c.startswith(prefixes) or c in names]:
        raise GateError(f"prohibited columns: {bad}")
    return df


def require_column_counts(df: DataFrame, counts: dict[str, int]) -> DataFrame:
    """So many columns for each prefix."""
    found = {p: sum(c.startswith(p) for c in df.columns) for p in counts}
    if found != counts:
        raise GateError(f"columns by prefix: {found}, not {counts}")
    return df


def measure(df: DataFrame, key: str, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Rows, different keys, null keys and rows that break each condition, in one aggregation.

    A condition that is null is broken: three-valued logic must not let a row slip through.
    """
    broken = {n: F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(f"broken_{n}") for n, c in (conditions or {}).items()}
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.sum(F.col(key).isNull().cast("long")).alias("null_keys"), *broken.values()
    )


def enforce(df: DataFrame, key: str, rows: int | None = None, conditions: dict[str, Column] | None = None) -> DataFrame:
    """Runs ``measure`` and refuses a table with another row count, repeated or null keys or broken conditions."""
    m = measure(df, key, conditions).first().asDict()
    bad = {k: v for k, v in m.items() if k.startswith("broken_") and v}
    if rows is not None and m["n_rows"] != rows:
        bad["n_rows"] = m["n_rows"]
    if m["n_keys"] != m["n_rows"] or m["null_keys"]:
        bad["n_keys"] = m["n_keys"]
    if bad:
        raise GateError(f"contract broken: {bad}")
    return df


def group_counts(df: DataFrame, by: str, locked: dict[str, int]) -> DataFrame:
    """Counts per group next to locked counts; ``ok`` is false for groups that differ, are missing or are new."""
    spark = df.sparkSession
    want = spark.createDataFrame([(k, v) for k, v in locked.items()], "_g string, locked long")
    have = df.groupBy(F.col(by).cast("string").alias("grp")).agg(F.count("*").alias("n"))
    t = have.join(want, F.col("grp").eqNullSafe(F.col("_g")), "full")
    return t.select(F.coalesce("grp", "_g").alias("grp"), "n", "locked", F.col("n").eqNullSafe(F.col("locked")).alias("ok"))


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys that only one side has, or whose values differ by more than ``tolerance``, by a full outer join."""
    x, y = a.select(F.col(key).alias("_a"), F.col(value).alias("left_value")), b.select(F.col(key).alias("_b"), F.col(value).alias("right_value"))
    t = x.join(y, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), "left_value", "right_value", F.col("_a").isNull().alias("only_right"), F.col("_b").isNull().alias("only_left"))
    differs = ~F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.col("left_value").isNull() & F.col("right_value").isNull())
    return t.where(F.col("only_left") | F.col("only_right") | differs)


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys (null among them) that only one side has, and which: ``only_left``. Both sides are one pre-aggregated grouping, so
    a key that fills a side is a row a task."""
    x, y = a.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")), b.select(F.col(key), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    t = x.unionByName(y).groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return t.where(F.col("_l") != F.col("_r")).select(key, (F.col("_l") == 1).alias("only_left"))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return not key_differences(a, b, key).limit(1).count()


def nested_values(df: DataFrame, paths: dict[str, str], checks: dict[str, Callable]) -> dict:
    """Values at dotted paths of a one-row summary (field names may start with digits), each checked; wrong ones raise."""
    row = df.select(*[F.col(".".join(f"`{p}`" for p in path.split("."))).alias(n) for n, path in paths.items()]).first().asDict()
    if bad := {n: row[n] for n, ok in checks.items() if not ok(row[n])}:
        raise GateError(f"summary values: {bad}")
    return row
