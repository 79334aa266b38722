"""Cohorts: each row is kept or excluded with the first reason that holds; both come from one status column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.scalars import boolean, let, model_position_group


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, null if none does; a null condition doesn't hold."""
    head, *rest = reasons
    start = F.when(F.coalesce(head[1], F.lit(False)), F.lit(head[0]))
    return reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), F.lit(r[0])), rest, start)


def by_group(group: Column, columns: dict[str, str], prefix: str, have: list[str]) -> Column:
    """The value of the column that a row's group names; null for other groups and absent columns."""

    def chosen(named: Column) -> Column:
        c = F.lit(None).cast("double")
        for g, name in columns.items():
            if f"{prefix}{name}" in have:
                c = F.when(named == g, F.col(f"{prefix}{name}").cast("double")).otherwise(c)
        return c

    return let(group, chosen)


def with_targets(rows: DataFrame, position: str, targets: dict[str, str] = C.TARGETS) -> DataFrame:
    """Group, target metric, and the anchors before and after that the group's target names."""
    # A column of its own, so that codes are folded once; each further column names it once.
    rows = rows.withColumn("model_group", model_position_group(F.col(position)))
    group = F.col("model_group")
    table = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return rows.withColumns(
        {
            "target_metric": F.try_element_at(table, group),
            "pre_anchor": by_group(group, targets, "pre_", rows.columns),
            "post_anchor": by_group(group, targets, "post_", rows.columns),
        }
    )


def modelling_both_anchors(rows: DataFrame) -> DataFrame:
    """First version: a target needs both anchors; adds ``exclusion_reason`` and ``target_delta``."""
    reason = first_reason(
        [
            ("unsupported_position_target", F.col("target_metric").isNull()),
            ("missing_pre_anchor", F.col("pre_anchor").isNull()),
            ("missing_post_anchor", F.col("post_anchor").isNull()),
        ]
    )
    return rows.withColumns({"exclusion_reason": reason, "target_delta": F.col("post_anchor") - F.col("pre_anchor")})


def modelling_outcome_observed(rows: DataFrame) -> DataFrame:
    """Second version: only the outcome must be observed; a missing prior is kept as missing."""
    reason = first_reason(
        [
            ("post_outcome_right_censored", F.col("post_outcome_right_censored")),
            ("unsupported_position_target", F.col("target_metric").isNull()),
            ("missing_post_target", F.col("post_anchor").isNull()),
        ]
    )
    return rows.withColumns(
        {
            "exclusion_reason": reason,
            "target_delta": F.col("post_anchor") - F.col("pre_anchor"),
            "baseline_missing": F.col("pre_anchor").isNull(),
        }
    )


def negative_control(rows: DataFrame, history: DataFrame, first_season: int) -> DataFrame:
    """Change of the seasons before, from values two seasons back; ``history`` has ``player_id``, ``season``, ``metric``,
    ``value``. Several different values two seasons back are ambiguous, none is missing."""
    old = history.groupBy("player_id", "metric", (F.col("season") + 2).alias("season")).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    old = old.select(
        F.col("player_id").alias("_p"), F.col("metric").alias("_m"), F.col("season").alias("_s"),
        (F.col("low") != F.col("high")).alias("s2_ambiguous"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("s2_anchor"),
    )
    on = (F.col("player_id") == F.col("_p")) & (F.col("target_metric") == F.col("_m")) & (F.col("season") == F.col("_s"))
    rows = rows.join(old, on, "left").drop("_p", "_m", "_s")
    reason = first_reason(
        [
            ("s2_source_unavailable", F.col("season") < first_season),
            ("unsupported_target_metric", F.col("target_metric").isNull()),
            ("missing_s1_anchor", F.col("pre_anchor").isNull()),
            ("ambiguous_s2_anchor", F.col("s2_ambiguous")),
            ("missing_s2_anchor", F.col("s2_anchor").isNull()),
        ]
    )
    return rows.withColumns({"exclusion_reason": reason, "prior_change": F.col("pre_anchor") - F.col("s2_anchor")})


def observability(rows: DataFrame, last_season: int = 2025, first_season: int = 2021, groups: tuple[str, ...] = C.SCOREABLE) -> DataFrame:
    """Whether the target is observed (1/0) for same-season links of the scoreable groups in the design's seasons.

    Every row is kept with the first reason that excludes it. Where the table tells (``post_has_player_stats``,
    ``post_has_destination_stats``, ``has_features``), flags say whether anything at all, or anything at the destination,
    was observed, and rows without features are excluded. No later column is carried along.
    """
    have = set(rows.columns)
    source = F.col("post_stats_source_available") if "post_stats_source_available" in have else ~F.col("post_outcome_right_censored")
    reasons = [
        ("outside_seasons", ~F.coalesce(F.col("season").between(first_season, last_season), F.lit(False))),
        ("not_same_season_roster_link", ~F.coalesce(F.col("match_strategy") == "same_season", F.lit(False))),
        ("post_stats_source_unavailable", ~F.coalesce(source, F.lit(False))),
        ("unsupported_position", ~F.coalesce(F.col("model_group").isin(*groups), F.lit(False))),
    ]
    if "has_features" in have:
        reasons.append(("missing_feature_row", ~F.coalesce(F.col("has_features"), F.lit(False))))
    target = F.col("post_anchor").isNotNull().cast("int")
    added = {"exclusion_reason": first_reason(reasons), "target_observed": target}
    if "post_has_player_stats" in have:
        seen = F.coalesce(F.col("post_has_player_stats"), F.lit(False)).cast("int")
        added |= {"any_stat_observed": seen, "any_stat_no_target": seen * (1 - target), "no_any_stat": 1 - seen}
    if "post_has_destination_stats" in have:
        added["destination_stat_observed"] = F.coalesce(F.col("post_has_destination_stats"), F.lit(False)).cast("int")
    flagged = rows.withColumns(added)
    return flagged.drop(*[c for c in flagged.columns if c.startswith("post_")])


def scoring(rows: DataFrame, season: int, scoreable: tuple[str, ...] = C.SCOREABLE) -> DataFrame:
    """Rows of one season: kept, or excluded for want of a target or of validation evidence. Other seasons are in neither."""
    reason = first_reason(
        [
            ("unsupported_position_target", F.col("target_metric").isNull()),
            ("insufficient_validation_evidence", ~F.col("model_group").isin(*scoreable)),
        ]
    )
    return rows.where(F.col("season") == season).withColumn("exclusion_reason", reason)


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("exclusion_reason").isNull()).drop("exclusion_reason")


def excluded(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("exclusion_reason").isNotNull())


def support(missing_anchor: Column, missing_count: Column) -> tuple[Column, Column]:
    """How well a forecast is supported, and why: a missing anchor outweighs the count; a negative count is an error."""
    gone, n = boolean(missing_anchor), F.trim(missing_count.cast("string")).cast("int")
    bad = n.isNull() | (n < 0)
    checked = F.when(bad, F.raise_error(F.lit("a count is missing or negative")).cast("int")).otherwise(n)
    label = F.when(gone, F.lit("LIMITED")).when(checked <= 2, F.lit("STRONG")).otherwise(F.lit("STANDARD"))
    why = F.when(gone, F.lit("baseline_missing")).when(checked <= 2, F.lit("baseline_and_most_features")).otherwise(F.lit("several_features_missing"))
    return label, why


def assert_no_leak(rows: DataFrame, prefix: str = "post_", allowed: tuple[str, ...] = ()) -> DataFrame:
    """Refuses a table with columns from after the event."""
    if bad := [c for c in rows.columns if c.startswith(prefix) and c not in allowed]:
        raise ValueError(f"columns from after the event: {bad}")
    return rows
