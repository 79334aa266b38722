"""Queries behind a dashboard: filters, ranks within groups, top lists, cross tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import contains_text


def filtered(rows: DataFrame, choices: dict[str, list], text: str = "", columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that match all non-empty choices and hold the text in any of the columns, ignoring case."""
    for c, allowed in choices.items():
        if allowed:
            rows = rows.where(F.col(c).isin(*allowed))
    if text and columns:
        hit = F.lit(False)
        for c in columns:
            hit |= contains_text(F.col(c), text)
        rows = rows.where(hit)
    return rows


def ranked(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Rank within a group by descending value, equal values sharing the smaller rank; call it after filtering."""
    return rows.withColumn("group_rank", F.rank().over(Window.partitionBy(by).orderBy(F.col(value).desc())).cast("long"))


def top(rows: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` highest rows, lowest first; no sort of the whole table."""
    return rows.orderBy(F.col(value).desc(), *ties).limit(n).orderBy(F.col(value), *ties)


def cross_table(rows: DataFrame, by: str, across: str, values: list[str]) -> DataFrame:
    """Counts of ``across`` per ``by``, 0 where none, with the row total."""
    t = rows.groupBy(by).pivot(across, values).count().na.fill(0, subset=values)
    return t.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0).cast("long")))


def in_order(rows: DataFrame, column: str, order: list[str], *then: str) -> DataFrame:
    """Ordered by the place of a value in a list; values that aren't in it come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return rows.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), *then)


def overview(rows: DataFrame, category: str, value: str) -> DataFrame:
    """Mode (of equally frequent ones the smallest), least, largest and number of different values."""
    return rows.agg(F.mode(category, True).alias("mode"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_distinct(category).alias("n_different"))
