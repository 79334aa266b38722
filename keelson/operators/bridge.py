"""Point-in-time links: what is known before a season and what is observed in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize_team, present


def resolved_only(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("status") == "resolved") & present(F.col("player_id")))


def needed_stats(links: DataFrame, stats: DataFrame) -> DataFrame:
    """The stat rows of the linked players in the seasons before and of their links: a semi-join reduction."""
    # As in ``linked_stats``, null keys are dropped behind the explode.
    sides = [F.struct("player_id", (F.col("season") - shift).alias("season")) for shift in (1, 0)]
    needed = links.select(F.explode(F.array(*sides)).alias("_side")).select("_side.*").distinct()
    return stats.join(needed, ["player_id", "season"], "left_semi")


def _side(stats: DataFrame, prefix: str) -> DataFrame:
    """Per player and season: rows and teams, and rows per normalised team."""
    by_team = stats.groupBy("player_id", "season", F.trim("team").alias("team")).agg(F.count("*").alias("n"))
    return by_team.groupBy(F.col("player_id").alias(f"{prefix}_id"), F.col("season").alias(f"{prefix}_season_key")).agg(
        F.sum("n").alias(f"{prefix}_stat_row_count"),
        F.array_sort(F.collect_set(F.when(F.col("team") != "", F.col("team")))).alias(f"{prefix}_stat_teams"),
        F.collect_list(F.struct(normalize_team(F.col("team")).alias("t"), "n")).alias(f"_{prefix}"),
    )


def _rows_of(counts: Column, team: Column) -> Column:
    """Rows of one team in an array of (team, rows)."""
    return F.aggregate(F.filter(counts, lambda x: x["t"] == team), F.lit(0).cast("long"), lambda a, x: a + x["n"])


def season_bridge(links: DataFrame, stats: DataFrame) -> DataFrame:
    """Each link with its player's stats of the season before (at the origin) and of the season (at the destination).

    Stats are aggregated to one row per player and season before two left joins on (player, season), never on a lag of
    rows, as seasons have gaps. A season is available if it has any rows; the outcome of a link whose season has none is
    right-censored, which is not the same as a player without rows.
    """
    have = stats.select("season").distinct()
    rows = links.withColumn("pre_season", F.col("season") - 1)
    first = [*rows.columns, "pre_stat_row_count", "pre_stat_teams", "post_stat_row_count", "post_stat_teams"]
    needed = needed_stats(links, stats)
    # What a side tells is counted right after its join, so that no list of teams goes on to the shuffle of the next.
    for side, season in (("pre", "pre_season"), ("post", "season")):
        same = (F.col("player_id") == F.col(f"{side}_id")) & (F.col(season) == F.col(f"{side}_season_key"))
        rows = rows.join(_side(needed, side), same, "left")
        seen = have.select(F.col("season").alias("_s"), F.lit(True).alias(f"{side}_source_available"))
        rows = rows.join(seen, F.col(season) == F.col("_s"), "left").drop("_s")
        team = normalize_team(F.col("origin" if side == "pre" else "destination"))
        expected = _rows_of(F.col(f"_{side}"), team)
        count = F.coalesce(F.col(f"{side}_stat_row_count"), F.lit(0).cast("long"))
        rows = rows.withColumns(
            {
                f"{side}_source_available": F.coalesce(f"{side}_source_available", F.lit(False)),
                f"{side}_expected_row_count": F.coalesce(expected, F.lit(0).cast("long")),
                f"{side}_stat_row_count": count,
                f"{side}_stat_teams": F.coalesce(f"{side}_stat_teams", F.array().cast("array<string>")),
            }
        )
        rows = rows.withColumns(
            {
                f"{side}_has_stats": F.col(f"{side}_stat_row_count") > 0,
                f"{side}_has_expected_stats": F.col(f"{side}_expected_row_count") > 0,
                f"{side}_team_mismatch": (F.col(f"{side}_stat_row_count") > 0) & (F.col(f"{side}_expected_row_count") == 0),
            }
        ).drop(f"{side}_id", f"{side}_season_key", f"_{side}")
    rows = rows.withColumns(
        {
            "complete_pre_post": F.col("pre_has_expected_stats") & F.col("post_has_expected_stats"),
            "post_outcome_right_censored": ~F.col("post_source_available"),
        }
    )
    return rows.select(*[F.col(f"`{c}`") for c in (*first, *(c for c in rows.columns if c not in first))])


def linked_stats(links: DataFrame, stats: DataFrame) -> DataFrame:
    """Long stat rows of the expected team only, ``phase`` pre or post."""
    sides = [
        F.struct("player_id", F.lit(shift == 1).alias("_pre"), (F.col("season") - shift).alias("season"), normalize_team(F.col(team)).alias("_team"))
        for phase, shift, team in (("pre", 1, "origin"), ("post", 0, "destination"))
    ]
    # Keys come out of the explode, so null ones are dropped behind it: a shuffle that makes the links serves the bridge too.
    expected = links.select("entry_key", F.explode(F.array(*sides)).alias("_side")).select("entry_key", "_side.*")
    # A column before the join: as an expression in its condition, teams would be normalised for every comparison of a sort.
    both = stats.withColumn("_team", normalize_team(F.col("team"))).join(expected, ["player_id", "season", "_team"])
    phase = F.when(F.col("_pre"), F.lit("pre")).otherwise(F.lit("post"))
    return both.select("entry_key", "player_id", "category", "stat_type", "stat", "season", "team", phase.alias("phase"))


def summary(bridge: DataFrame) -> DataFrame:
    """Conditional counts per season in one aggregation."""
    flags = ("pre_has_stats", "pre_has_expected_stats", "post_has_stats", "post_has_expected_stats", "complete_pre_post", "post_outcome_right_censored", "pre_team_mismatch", "post_team_mismatch")
    return bridge.groupBy("season").agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags])


def lag_by_season(rows: DataFrame, key: list[str], value: str, years: int) -> DataFrame:
    """``value`` of ``years`` seasons before, by a self-join on the season; null where that season is absent."""
    old = rows.select(*key, (F.col("season") + years).alias("season"), F.col(value).alias(f"{value}_s{years}"))
    return rows.join(old, [*key, "season"], "left")
