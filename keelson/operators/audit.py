"""Accounting, audit samples, labelled accuracy and weighted precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import AUDIT_ROWS, AUDIT_SEED, WILSON_Z
from ..functions.scalars import share


def accounting(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, resolved, held out (ambiguous, for review or unresolved) and resolved rate (null without rows), per group or
    in all."""
    held = F.col("status").isin("ambiguous", "review", "unresolved")
    return (
        rows.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.sum((F.col("status") == "resolved").cast("long")).alias("resolved"),
            F.sum(held.cast("long")).alias("held_out"),
        )
        .withColumn("resolved_rate", share(F.col("resolved"), F.col("n")))
    )


def counts_with_share(rows: DataFrame, total_by: list[str], by: list[str]) -> DataFrame:
    """Counts per ``by`` with their share of the count per ``total_by``, from one aggregation of the rows."""
    counts = rows.groupBy(*total_by, *by).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*total_by).agg(F.sum("n").alias("total"))
    return counts.join(totals, total_by).withColumn("share", F.col("n") / F.col("total"))


def stratified_sample(rows: DataFrame, key: str, strata: list[str], k: int = AUDIT_ROWS, seed: int = AUDIT_SEED) -> DataFrame:
    """``k`` rows of each stratum, the smallest by a seeded hash of the key: independent of row order and layout."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return (
        rows.withColumn("_o", order)
        .withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy("_o", key)))
        .where(F.col("_n") <= k)
        .drop("_o", "_n")
    )


# The columns of the label sheet.
LABEL_COLUMNS = (
    "portal_key", "season", "first_name", "last_name", "position", "origin", "destination",
    "predicted_status", "predicted_player_id", "predicted_score", "expected_player_id",
    "label_outcome", "split", "reviewer", "notes",
)


def label_template(rows: DataFrame) -> DataFrame:
    """The sheet that auditors fill in: fifteen fixed columns. What auditors decide is blank, as is what ``rows`` lacks."""
    source = {"portal_key": "entry_key", "predicted_status": "status", "predicted_player_id": "player_id", "predicted_score": "score"}
    blank = ("expected_player_id", "label_outcome", "split", "reviewer", "notes")
    known = {c: source.get(c, c) for c in LABEL_COLUMNS if c not in blank and source.get(c, c) in rows.columns}
    return rows.select(*[F.coalesce(F.col(known[c]).cast("string"), F.lit("")).alias(c) if c in known else F.lit("").alias(c) for c in LABEL_COLUMNS])


def labelled_accuracy(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows, correct, false positives and false negatives; unlabelled rows don't count.

    Labels and rows meet on ``entry_key`` without blanks around it, or, for labels without one, on season, name, origin and
    destination, these without blanks around them and in lower case. Two blanks are correct nowhere: they fall in none
    of the counts but the first.
    """
    both = _labelled(rows, labels)
    found = F.coalesce("player_id", F.lit(""))
    flags = {
        "correct": (found == F.col("expected")) & (found != ""),
        "false_positive": (found != "") & (found != F.col("expected")),
        "false_negative": (found == "") & (F.col("expected") != ""),
    }
    out = both.agg(F.count("*").alias("labelled"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in flags.items()])
    return out.withColumn("accuracy", share(F.col("correct"), F.col("labelled")))


def labelled_status(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """How many of the rows that ``labelled_accuracy`` counts have each status."""
    return _labelled(rows, labels).groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that have a label, with what it expects; of several labels for a key the last one counts."""
    fields = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in ("first_name", "last_name", "origin", "destination")]
    # Each field with its length, so that no two lists of fields look alike.
    composite = F.concat(F.coalesce(F.col("season").cast("string"), F.lit("")), *[x for f in fields for x in (F.lit("|"), F.length(f).cast("string"), F.lit(":"), f)])
    name = F.trim(F.coalesce(F.col("entry_key").cast("string"), F.lit("")))
    key = F.when(name == "", F.concat(F.lit("c:"), composite)).otherwise(F.concat(F.lit("k:"), name))
    expected = labels.select(key.alias("_key"), F.coalesce("expected_player_id", F.lit("")).alias("expected"), "ordinal")
    expected = expected.groupBy("_key").agg(F.max_by("expected", "ordinal").alias("expected"))
    return rows.withColumn("_key", key).join(expected, "_key")


def wilson(p: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """The Wilson interval of a rate, within [0, 1]; null for n of 0."""
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def stratum_rates(labels: DataFrame, stratum: str, outcome: str = "label_outcome") -> DataFrame:
    """Counts of correct, incorrect and uncertain labels per stratum with strict, adjudicated and possible rates."""
    o = F.lower(F.trim(F.col(outcome)))
    t = labels.groupBy(stratum).agg(
        F.count("*").alias("sample_n"), *[F.sum((o == x).cast("long")).alias(x) for x in ("correct", "incorrect", "uncertain")]
    )
    return t.withColumns(
        {
            "strict_rate": F.col("correct") / F.col("sample_n"),
            "adjudicated_rate": share(F.col("correct"), F.col("correct") + F.col("incorrect")),
            "possible_rate": (F.col("correct") + F.col("uncertain")) / F.col("sample_n"),
        }
    )


def weighted_precision(labels: DataFrame, population: DataFrame, stratum: str) -> DataFrame:
    """Population-weighted rates over strata, Kish's effective sample size and the Wilson interval of the strict rate.

    ``population`` has ``stratum`` and ``population_n``. Strata whose labels are all uncertain have no adjudicated rate
    and add nothing to it; weights are not scaled up for them.
    """
    rows = stratum_rates(labels, stratum).join(population, stratum)
    t = rows.agg(
        F.sum("population_n").alias("population"),
        F.sum(F.col("population_n") * F.col("strict_rate")).alias("s"),
        F.sum(F.col("population_n") * F.col("adjudicated_rate")).alias("a"),
        F.sum(F.col("population_n") * F.col("possible_rate")).alias("p"),
        F.sum(F.col("population_n") * F.col("population_n") / F.col("sample_n")).alias("q"),
    )
    n = F.col("population").cast("double")
    t = t.select(
        "population",
        (F.col("s") / n).alias("strict_rate"),
        (F.coalesce("a", F.lit(0.0)) / n).alias("adjudicated_rate"),
        (F.col("p") / n).alias("possible_rate"),
        (n * n / F.col("q")).alias("effective_n"),
    )
    low, high = wilson(F.col("strict_rate"), F.col("effective_n"))
    return t.withColumns({"strict_low": low, "strict_high": high})


def combined_precision(weighted: DataFrame, census: DataFrame, outcome: str = "label_outcome") -> DataFrame:
    """The sampled population's estimate together with a group that was labelled in full."""
    o = F.lower(F.trim(F.col(outcome)))
    c = census.agg(
        F.count("*").alias("census_n"),
        F.sum((o == "correct").cast("long")).alias("census_correct"),
        F.sum((o == "uncertain").cast("long")).alias("census_uncertain"),
    )
    # Two rows of one line each.
    t = weighted.withColumn("_one", F.lit(1)).join(c.withColumn("_one", F.lit(1)), "_one").drop("_one")
    total = F.col("population") + F.col("census_n")
    whole = {f"combined_{x}": (F.col("population") * F.col(f"strict_{x}") + F.col("census_correct")) / total for x in ("rate", "low", "high")}
    possible = (F.col("population") * F.col("possible_rate") + F.col("census_correct") + F.col("census_uncertain")) / total
    return t.withColumns({**whole, "combined_possible": possible, "census_rate": F.col("census_correct") / F.col("census_n")})


def label_conflicts(labels: DataFrame) -> DataFrame:
    """Numbers of labels that contradict themselves: unknown outcomes, correct ones whose ids differ, uncertain ones with an id."""
    o = F.lower(F.trim(F.coalesce("label_outcome", F.lit(""))))
    predicted, expected = (F.trim(F.coalesce(c, F.lit(""))) for c in ("predicted_player_id", "expected_player_id"))
    checks = {
        "unknown_outcome": ~o.isin("correct", "incorrect", "uncertain"),
        "correct_but_different": (o == "correct") & (predicted != expected),
        "uncertain_with_id": (o == "uncertain") & (expected != ""),
    }
    return labels.agg(*[F.sum(c.cast("long")).alias(n) for n, c in checks.items()])
