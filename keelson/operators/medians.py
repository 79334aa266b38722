"""Exact medians of groups of any size, also over expanding windows of seasons, by distributed selection.

A double is a number of 64 bits that keeps its order. Each round counts a group's values by their next bits and keeps
the part of the range that holds the two middle ranks, so no task ever holds a group's values and nothing grows with how
many different ones there are. Counts are kept for each season: all windows of a group share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialize

SHIFTS = (40, 20, 0)  #: bits that a round leaves for later ones
CELLS = 1 << 20  #: a cell of no more values has all of its bits looked at in one round
_TOP = 1023


def ordered_bits(c: Column) -> Column:
    """A long that orders as the double does; NaN is above all, 0.0 and -0.0 are equal."""
    x = F.abs(c)
    guess = F.greatest(F.floor(F.log2(x)), F.lit(1 - _TOP)).cast("int")
    # A logarithm next to a whole number may be rounded to its other side.
    e = F.when(F.pow(F.lit(2.0), guess + 1) <= x, guess + 1).when((F.pow(F.lit(2.0), guess) > x) & (guess > 1 - _TOP), guess - 1).otherwise(guess)
    # Two factors, as 2**-1074 has no inverse. Numbers below 2**-1022 go on at the same distances.
    fraction = x * F.pow(F.lit(2.0), F.lit(52) - e - F.when(e < -900, F.lit(200)).otherwise(F.lit(0))) * F.when(e < -900, F.lit(2.0**200)).otherwise(F.lit(1.0))
    size = (e.cast("long") + (_TOP - 1)) * F.lit(1 << 52) + fraction.cast("long")
    size = F.when(x == 0, F.lit(0)).when(x == float("inf"), F.lit((2 * _TOP + 1) << 52)).otherwise(size)
    return F.when(F.isnan(c), F.lit((1 << 63) - 1)).otherwise(F.when(c < 0, -size).otherwise(size)).cast("long")


def _long(rows: DataFrame, by: list[str], values: list[Column], season: Column) -> DataFrame:
    """One row per value: group, ``_s`` season, ``_c`` number of the column, ``_v`` value, ``_key`` its bits."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), v.cast("double").alias("v")) for i, v in enumerate(values)]))
    t = rows.select(*by, season.cast("int").alias("_s"), cells.alias("_x")).where(F.col("_x.v").isNotNull())
    t = t.select(*by, "_s", F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v"))
    return t.withColumn("_key", ordered_bits(F.col("_v")))


def _picked(counts: DataFrame, states: DataFrame, on: list[str], window: list[str]) -> DataFrame:
    """For each state, the cell that holds its rank, and the rank within it."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}"))
    joined = states.alias("s").join(counts.alias("h"), same & (F.col("h._s") < F.col("s._before")))
    cells = joined.groupBy(*[F.col(f"s.{c}").alias(c) for c in window], F.col("s._rank").alias("_rank"), F.col("h._cell").alias("_cell")).agg(
        F.sum("h._n").alias("_n"), F.min("h._lo").alias("_lo"), F.max("h._hi").alias("_hi")
    )
    upto = Window.partitionBy(*window).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_rank", F.col("_rank") - F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    return cells.where((F.col("_rank") >= 0) & (F.col("_rank") < F.col("_n")))


def _rounds(rows: DataFrame, by: list[str], values: list[Column], season: Column, windows: DataFrame | None) -> DataFrame:
    """Long results: group, ``_before``, ``_c`` and ``median``."""
    data = _long(rows, by, values, season)
    window = [*by, "_before", "_c", "_which"]
    states, done, last, shift = None, [], None, SHIFTS[0]
    while True:
        prefix = F.lit(0).cast("long") if last is None else F.shiftright("_key", last)
        now = data.withColumns({"_prefix": prefix, "_cell": F.shiftright("_key", shift)})
        live = [*by, "_c", "_prefix"]
        if states is not None:
            wanted = states.select(*live).distinct().toDF(*[f"_w{i}" for i in range(len(live))])
            same = F.lit(True)
            for i, c in enumerate(live):
                same = same & F.col(c).eqNullSafe(F.col(f"_w{i}"))
            now = now.join(wanted, same, "left_semi")
        counts = now.groupBy(*live, "_s", "_cell").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        if states is None:
            counts = materialize(counts, "median-counts")
            per = counts.groupBy(*by, "_c", "_s").agg(F.sum("_n").alias("_n"))
            # Without windows one that holds everything.
            if windows is None:
                per = per.withColumn("_before", F.lit((1 << 31) - 1))
            else:
                per = per.join(windows, F.col("_s") < F.col("_before"))
            total = per.groupBy(*by, "_before", "_c").agg(F.sum("_n").alias("_total"))
            both = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.floor((F.col("_total") - d) / 2).cast("long").alias("r")) for w, d in ((0, 1), (1, 0))]))
            states = total.withColumn("_x", both).select(*by, "_before", "_c", F.lit(0).cast("long").alias("_prefix"), F.col("_x.w").alias("_which"), F.col("_x.r").alias("_rank"))
        found = _picked(counts, states, live, [*window, "_prefix"])
        if shift == 0:
            # All bits were looked at: a cell is one value.
            done.append(found.select(*window, F.col("_lo").alias("_v")))
            break
        found = materialize(found, "median-cells")
        one = F.col("_lo") == F.col("_hi")
        done.append(found.where(one).select(*window, F.col("_lo").alias("_v")))
        states = found.where(~one).select(*by, "_before", "_c", F.col("_cell").alias("_prefix"), "_which", "_rank")
        most = found.where(~one).agg(F.max("_n")).first()[0]
        if most is None:
            break
        last, shift = shift, 0 if most <= CELLS else SHIFTS[SHIFTS.index(shift) + 1]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy(*by, "_before", "_c").agg((F.sum("_v") / 2).alias("_sum"), F.min("_v").alias("_a"), F.max("_v").alias("_b")).select(
        *by, "_before", "_c", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") / 2 + F.col("_b") / 2).alias("median")
    )


def medians(rows: DataFrame, by: list[str], columns: list[str], prefix: str = "_m_") -> DataFrame:
    """``prefix`` + column for each column and group: the exact median of its values that aren't null; null without any.

    Equal to ``median`` but for memory: rounds of counts by the values' next bits, however large a group is and however
    many different values it has. Null groups are a group. The values' columns are read once for each round: two where no
    two values of the middle cells agree in their first 44 bits, three at most.
    """
    found = _rounds(rows, by, [F.col(f"`{c}`") for c in columns], F.lit(0), None)
    return _wide(rows, by, found, columns, prefix)


def _wide(rows: DataFrame, by: list[str], found: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    named = [F.max(F.when(F.col("_c") == i, F.col("median"))).alias(f"{prefix}{c}") for i, c in enumerate(columns)]
    wide = found.groupBy(*by).agg(*named) if by else found.agg(*named)
    if not by:
        return wide
    groups = rows.select(*by).distinct()
    same = F.lit(True)
    other = wide.toDF(*[f"_g{i}" for i in range(len(by))], *wide.columns[len(by) :])
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return groups.join(other, same, "left").drop(*[f"_g{i}" for i in range(len(by))])


def expanding_medians(rows: DataFrame, by: list[str], values: list[Column], season: str, years: list[int]) -> DataFrame:
    """For each group and year, ``medians``: an array with the exact median of each of ``values`` over the seasons before
    that year, null where there is none. Windows without any value are absent; rows are read once for each round, however
    many windows there are."""
    spark = rows.sparkSession
    windows = spark.createDataFrame([(y,) for y in years], "_before int")
    found = _rounds(rows, by, values, F.col(season), windows)
    cells = F.array(*[F.max(F.when(F.col("_c") == i, F.col("median"))) for i in range(len(values))])
    return found.groupBy(*by, F.col("_before").alias("year")).agg(cells.alias("medians"))
