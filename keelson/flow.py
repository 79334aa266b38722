"""The steps from landed files to presented forecasts. A step reads published tables of a schema and publishes its own.

Tables with a key are published with their gates and a lock (``sources.publish``); a step that fails leaves what was
published before. Steps only hand tables to each other, so each can be run again alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions.scalars import entry_key, feature_name, first_present, strict_number
from .operators import audit, backtest, bridge, cohorts, features, present, resolve
from .operators import windows as W
from .operators.gates import GateError
from .sources import publish, tables
from .sources.scratch import materialize, workspace

#: Kinds of statistics (columns of the matrix) that a table may have.
MAX_FEATURES = 2000

ENTRY = {
    "season": ("season",), "first_name": ("first_name", "firstName"), "last_name": ("last_name", "lastName"), "position": ("position",), "origin": ("origin",),
    "destination": ("destination",), "transfer_date": ("transfer_date", "transferDate"), "rating": ("rating",), "stars": ("stars",), "eligibility": ("eligibility",),
}
ROSTER = {
    "player_id": ("player_id", "playerId", "id"), "season": ("season", "year"), "team": ("team",), "first_name": ("first_name", "firstName"),
    "last_name": ("last_name", "lastName"), "position": ("position",),
}
STATS = {
    "player_id": ("player_id", "playerId"), "season": ("season", "year"), "team": ("team",), "category": ("category",), "stat_type": ("stat_type", "statType"), "stat": ("stat",),
}
_KINDS = {"season": "int", "rating": "double", "stars": "double"}


@dataclass(frozen=True)
class Settings:
    """``years`` are holdout years, ``season`` the one to be scored, ``first`` the first season with statistics two years
    back; ``groups`` those that may be scored."""

    years: tuple[int, ...]
    season: int
    first: int
    predictors: W.Predictors = field(default_factory=lambda: dict(C.PREDICTORS))
    groups: tuple[str, ...] = C.SCOREABLE
    audit_rows: int = C.AUDIT_ROWS
    rolling: backtest.Gates = backtest.ROLLING
    holdout: backtest.Gates = backtest.HOLDOUT
    control: backtest.Gates = backtest.CONTROL
    observability: backtest.Gates = backtest.OBSERVABILITY


@dataclass(frozen=True)
class Table:
    """What a step publishes; with a ``key`` it is checked and locked."""

    rows: DataFrame
    key: str | None = None
    count: int | None = None
    conditions: dict[str, Column] | None = None


Read = Callable[[str], DataFrame]


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of rows by its ending: ``.json`` (arrays), ``.jsonl``, ``.csv``, anything else Parquet."""
    bare = path.rstrip("/").rstrip("*")
    if bare.endswith(".jsonl"):
        return spark.read.json(path)
    if bare.endswith(".json"):
        return tables.read_json_array(spark, path)
    return tables.read_csv(spark, path) if bare.endswith(".csv") else spark.read.parquet(path)


def named(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their canonical names, whatever the case of the source; absent ones are null. Numbers that aren't any are
    null, other columns are text."""
    kinds = {n: _KINDS.get(n, "string") for n in fields}
    return df.select(*[first_present(df.columns, *names).try_cast(kinds[n]).alias(n) for n, names in fields.items()])


def land(portal: DataFrame, roster: DataFrame, stats: DataFrame) -> dict[str, Table]:
    """Entries with their key, rosters and statistics under canonical names."""
    entries = named(portal, ENTRY)
    return {"entries": Table(entries.withColumn("entry_key", entry_key(entries.columns))), "roster": Table(named(roster, ROSTER)), "stats": Table(named(stats, STATS))}


def resolutions(read: Read, s: Settings) -> dict[str, Table]:
    """Every entry with its decision, the accounting overall and by season, and the sheet for auditors."""
    entries = read("entries")
    found = materialize(resolve.resolve_with_fallback(entries, read("roster")), "flow-resolutions")
    by_season = audit.accounting(found, "season")
    overall = audit.accounting(found).withColumn("season", F.lit(None).cast("int"))
    sample = audit.stratified_sample(found, "entry_key", ["status", "reason"], s.audit_rows)
    decided = F.col("status").isin("resolved", "review", "ambiguous", "unresolved")
    return {
        "resolutions": Table(found, "entry_key", entries.count(), {"status": decided, "resolved_id": (F.col("status") != "resolved") | F.col("player_id").isNotNull()}),
        "resolver_accounting": Table(by_season.unionByName(overall.select(*by_season.columns))),
        "label_sheet": Table(audit.label_template(sample)),
    }


def bridges(read: Read, s: Settings) -> dict[str, Table]:
    """Resolved entries with what is known before and observed after, their statistics, and a summary by season."""
    links, stats = bridge.resolved_only(read("resolutions")), read("stats")
    found = materialize(bridge.season_bridge(links, stats), "flow-bridge")
    return {
        "season_bridge": Table(found, "entry_key", links.count()),
        "linked_stats": Table(bridge.linked_stats(links, stats)),
        "bridge_summary": Table(bridge.summary(found)),
    }


def _wanted() -> set[str]:
    return {c for group in C.PREDICTORS.values() for c in group if c.startswith("pre_")} | {f"{p}_{t}" for p in ("pre", "post") for t in C.TARGETS.values()}


def matrix(read: Read, s: Settings) -> dict[str, Table]:
    """One row for each bridge row with a column for each kind of statistic; conflicting values stop the step."""
    links, values = read("season_bridge"), materialize(features.named_values(read("linked_stats")), "flow-values")
    if features.orphans(values, links).limit(1).count():
        raise GateError("statistics of entries that the bridge doesn't have")
    kinds = {r.feature for r in values.select("feature").where("feature is not null").distinct().limit(MAX_FEATURES + 1).collect()}
    if len(kinds) > MAX_FEATURES:
        raise GateError(f"more than {MAX_FEATURES} kinds of statistics")
    return {"feature_matrix": Table(features.matrix(links, values, sorted(kinds | _wanted())), "entry_key", links.count())}


def _targets(read: Read) -> DataFrame:
    rows = cohorts.with_targets(read("feature_matrix"), "position")
    return rows.withColumns({"baseline_pre_production": F.col("pre_anchor"), "target": F.col("post_anchor"), "prior": F.col("pre_anchor")})


def modelling(read: Read, s: Settings) -> dict[str, Table]:
    """Both versions of the modelling table and what the second leaves out, with the reasons."""
    rows = _targets(read)
    both, seen = cohorts.modelling_both_anchors(rows), cohorts.modelling_outcome_observed(rows)
    return {
        "modelling_v1": Table(cohorts.kept(both), "entry_key"),
        "modelling_v2": Table(cohorts.kept(seen), "entry_key", conditions={"target": F.col("target").isNotNull()}),
        "modelling_excluded": Table(cohorts.excluded(seen).select("entry_key", "season", "model_group", "exclusion_reason"), "entry_key"),
    }


def holdout(read: Read, s: Settings) -> dict[str, Table]:
    rows = backtest.rolling_ridge(read("modelling_v1"), [max(s.years)], s.predictors, "target", "prior", s.holdout, flags=False)
    return {"holdout": Table(backtest.evaluate(rows, "target"))}


def rolling(read: Read, s: Settings) -> dict[str, Table]:
    rows = read("modelling_v2")
    found = materialize(backtest.rolling_ridge(rows, list(s.years), s.predictors, "target", "prior", s.rolling), "flow-rolling")
    status = backtest.fold_status(backtest.folds(rows, list(s.years)), s.rolling)
    return {"rolling_predictions": Table(found), "rolling": Table(status.join(backtest.evaluate(found, "target"), ["holdout_year", "model_group"], "left"))}


def control(read: Read, s: Settings) -> dict[str, Table]:
    stats = read("stats")
    history = stats.select("player_id", "season", feature_name(F.col("category"), F.col("stat_type")).alias("metric"), strict_number(F.col("stat")).alias("value")).where("value is not null")
    panel = cohorts.negative_control(_targets(read), history, s.first)
    predictions, result = backtest.negative_control(cohorts.kept(panel), max(s.years), ["rating", "stars"], "destination", gates=s.control)
    return {"control": Table(result), "control_predictions": Table(predictions)}


def observability(read: Read, s: Settings) -> dict[str, Table]:
    """Which entries' targets are observed: the cohort with its reasons, rolling folds, and the last year as a stress test with
    its figures over all groups."""
    cohort = materialize(cohorts.observability(_targets(read).drop("target"), max(s.years), s.first, s.groups), "flow-observability")
    rows, label, last = cohorts.kept(cohort), "target_observed", [max(s.years)]
    p = materialize(backtest.rolling_logistic(rows, list(s.years), s.predictors, label, s.observability), "flow-probabilities")
    stress = p.where(F.col("holdout_year") == last[0])
    return {
        "observability_cohort": Table(cohort.groupBy("season", "model_group", "exclusion_reason").agg(F.count("*").alias("n"), F.sum(label).alias("observed"))),
        "observability": Table(backtest.evaluate_probabilities(rows, p, list(s.years), label, s.observability)),
        "stress_test": Table(backtest.evaluate_probabilities(rows, stress, last, label, s.observability)),
        "stress_test_overall": Table(backtest.pooled_probabilities(stress, label)),
    }


def scores(read: Read, s: Settings) -> dict[str, Table]:
    """Forecasts of the scoring season. The training table must still be what its lock says; no outcome is read."""
    cohort = materialize(cohorts.scoring(_targets(read), s.season, s.groups), "flow-scoring")
    kept = cohorts.kept(cohort)
    kept = kept.drop("target", *[c for c in kept.columns if c.startswith("post_")])
    found = backtest.final_fit(read("locked:modelling_v2"), kept, list(s.years), s.predictors, "target", s.rolling)
    missing = F.size(F.filter(W.vector(s.predictors), lambda v: v.isNull()))
    label, why = cohorts.support(F.col("baseline_pre_production").isNull().cast("string"), missing)
    about = kept.select("entry_key", "player_id", "first_name", "last_name", "position", "origin", "destination", "baseline_pre_production", label.alias("forecast_support"), why.alias("forecast_support_reason"))
    return {
        "predictions": Table(found.join(about, "entry_key"), "entry_key", conditions={"prediction": F.col("prediction").isNotNull()}),
        "scoring_excluded": Table(cohorts.excluded(cohort).select("entry_key", "model_group", "exclusion_reason"), "entry_key"),
    }


def presentation(read: Read, s: Settings) -> dict[str, Table]:
    """Ranks within groups and how well forecasts are supported."""
    rows = read("locked:predictions")
    return {
        "forecasts": Table(present.ranked(rows, "model_group", "prediction"), "entry_key"),
        "forecast_support": Table(present.cross_table(rows, "model_group", "forecast_support", ["STRONG", "STANDARD", "LIMITED"])),
    }


#: The steps in their order.
STEPS: dict[str, Callable[[Read, Settings], dict[str, Table]]] = {
    "resolutions": resolutions, "bridges": bridges, "matrix": matrix, "modelling": modelling, "holdout": holdout, "rolling": rolling, "control": control,
    "observability": observability, "scores": scores, "presentation": presentation,
}


def save(spark: SparkSession, schema: str, out: dict[str, Table]) -> dict[str, int | None]:
    """Publish tables; the rows of those with a key."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    counts = {}
    for name, t in out.items():
        if t.key:
            counts[name] = publish.publish_checked(t.rows, f"{schema}.{name}", t.key, t.count, t.conditions)["n_rows"]
        else:
            tables.publish(spark, {name: t.rows}, schema)
            counts[name] = None
    return counts


def run(spark: SparkSession, schema: str, settings: Settings, steps: list[str] | None = None) -> dict[str, int | None]:
    """Run ``steps`` (all, if none are named) in their order. Tables of a step's own are deleted when it has published."""
    if unknown := set(steps or ()) - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")

    def read(name: str) -> DataFrame:
        if name.startswith("locked:"):
            return publish.require_published(spark, f"{schema}.{name.removeprefix('locked:')}")
        return spark.table(f"{schema}.{name}")

    counts = {}
    for name, step in STEPS.items():
        if not steps or name in steps:
            with workspace(spark):
                counts |= save(spark, schema, step(read, settings))
    return counts
