"""Resolution, audit, bridge, features and cohorts as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, bridge, cohorts, features, resolve
from . import base
from .registry import query, table


def edit_ratio(a: Column, b: Column) -> Column:
    """A name similarity that SQL engines share: 1 - edit distance / length of the longer name, 0 for empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries: the name's words are first and last name, the brand is the team, the type the position."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.select(
        F.concat(F.lit("e"), "p_partkey").alias("entry_key"),
        F.lit(2024).alias("season"),
        words[0].alias("first_name"),
        F.element_at(words, -1).alias("last_name"),
        F.when(F.col("p_partkey") % 13 != 0, F.element_at(F.split("p_type", " "), -1)).alias("position"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("destination"),
        F.concat(F.lit("o"), F.col("p_size") % 5).alias("origin"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as roster rows: a sixth have a suffix, a third another last name, those of large size are of the next season."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.select(
        F.col("p_partkey").cast("string").alias("player_id"),
        F.when(F.col("p_size") > 40, 2025).otherwise(2024).alias("season"),
        F.upper("p_brand").alias("team"),
        words[0].alias("first_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.reverse(F.element_at(words, -1)))
        .otherwise(F.concat(F.element_at(words, -1), F.when(F.col("p_partkey") % 6 == 1, F.lit(" Jr.")).otherwise(F.lit(""))))
        .alias("last_name"),
        F.element_at(F.split("p_type", " "), -1).alias("position"),
    )


_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_RATIO = "CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"
RESOLVE_SQL = f"""e AS (
  SELECT 'e' || p_partkey AS entry_key, {_NORM.format("string_split(p_name, ' ')[1]")} AS f, {_NORM.format("string_split(p_name, ' ')[-1]")} AS l,
    upper(coalesce(CASE WHEN p_partkey % 13 <> 0 THEN string_split(p_type, ' ')[-1] END, '')) AS g,
    {_NORM.format("coalesce(CASE WHEN p_partkey % 17 <> 0 THEN p_brand END, '')")} AS team
  FROM part
), r AS (
  SELECT CAST(p_partkey AS VARCHAR) AS player_id, CASE WHEN p_size > 40 THEN 2025 ELSE 2024 END AS season, {_NORM.format('p_brand')} AS team,
    {_NORM.format("string_split(p_name, ' ')[1]")} AS f,
    {_NORM.format("CASE WHEN p_partkey % 3 = 0 THEN reverse(string_split(p_name, ' ')[-1]) ELSE string_split(p_name, ' ')[-1] END")} AS l, upper(string_split(p_type, ' ')[-1]) AS g
  FROM part
), years(y) AS (VALUES (2024), (2025)),
pair AS (
  SELECT y, entry_key, e.f AS ef, e.l AS el, e.g AS eg, r.* FROM e JOIN years ON true JOIN r ON r.team = e.team AND r.season = y WHERE e.team <> ''
), blocked AS (
  SELECT * FROM (SELECT *, max(CASE WHEN eg <> '' AND eg = g THEN 1 ELSE 0 END) OVER (PARTITION BY y, entry_key) AS hit FROM pair) WHERE hit = 0 OR eg = g
), scored AS (
  SELECT *, round(0.30 * (CASE WHEN ef <> '' AND ef = f THEN 1.0 ELSE {_RATIO.format(a='ef', b='f')} END) + 0.55 * ({_RATIO.format(a='el', b='l')})
    + 0.15 * (CASE WHEN eg = '' OR g = '' THEN 0.5 WHEN eg = g THEN 1.0 ELSE 0.0 END), 6) AS score, ef <> '' AND ef = f AND el = l AS exact
  FROM blocked
), numbered AS (SELECT *, row_number() OVER (PARTITION BY y, entry_key ORDER BY score DESC, player_id) AS k FROM scored),
ranked AS (
  SELECT y, entry_key, max(player_id) FILTER (k = 1) AS best_id, max(score) FILTER (k = 1) AS score, coalesce(max(score) FILTER (k = 2), 0.0) AS second_score,
    count(*) AS candidate_count, count(DISTINCT player_id) FILTER (exact) AS ids FROM numbered GROUP BY ALL
), d AS (
  SELECT y, e.entry_key, ranked.* EXCLUDE (y, entry_key), CASE WHEN e.team = '' THEN 'no_destination' WHEN score IS NULL THEN 'no_destination_roster_candidate'
    WHEN ids > 1 THEN 'same_name_collision' WHEN score >= 0.92 AND score - second_score >= 0.08 THEN 'high_confidence'
    WHEN score >= 0.82 AND score - second_score >= 0.03 THEN 'manual_review_required' WHEN score >= 0.82 THEN 'small_score_margin' ELSE 'low_match_score' END AS reason
  FROM e JOIN years ON true LEFT JOIN ranked USING (y, entry_key)
), decided AS (
  SELECT *, CASE WHEN reason = 'high_confidence' THEN 'resolved' WHEN reason = 'manual_review_required' THEN 'review'
    WHEN reason IN ('same_name_collision', 'small_score_margin') THEN 'ambiguous' ELSE 'unresolved' END AS status FROM d
)"""


@query("j01_block", f"WITH {RESOLVE_SQL} SELECT entry_key, player_id FROM blocked WHERE y = 2024")
def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block(entries(spark, sf_dir), roster(spark, sf_dir)).select("entry_key", "player_id")


@query("w01_r01_rank", f"WITH {RESOLVE_SQL} SELECT entry_key, best_id, round(score, 5) AS score, round(second_score, 5) AS second_score, candidate_count FROM ranked WHERE y = 2024")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = resolve.ranked(entries(spark, sf_dir), roster(spark, sf_dir), edit_ratio)
    return t.select("entry_key", "best_id", F.round("score", 5).alias("score"), F.round("second_score", 5).alias("second_score"), "candidate_count")


@query(
    "r02_decide",
    f"""WITH {RESOLVE_SQL} SELECT entry_key, status, reason, CASE WHEN status IN ('resolved', 'review') THEN best_id END AS player_id,
    coalesce(candidate_count, 0) AS candidate_count FROM decided WHERE y = 2024""",
)
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = resolve.resolve(entries(spark, sf_dir), roster(spark, sf_dir), edit_ratio)
    return t.select("entry_key", "status", "reason", "player_id", "candidate_count")


@query("r03_resolve")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(entries(spark, sf_dir), roster(spark, sf_dir))


@query("r01_j01_verified")
def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names per team, and those that the bound leaves for the real ratio."""
    return resolve.verified(entries(spark, sf_dir), roster(spark, sf_dir))


_STATES = f"""WITH {RESOLVE_SQL}, a AS (SELECT * FROM decided WHERE y = 2024), b AS (SELECT * FROM decided WHERE y = 2025),
s AS (
  SELECT a.entry_key, a.status AS same_season_status, a.reason AS same_season_reason, a.status = 'unresolved' AND a.reason <> 'no_destination' AS retry,
    b.status AS bs, b.reason AS br, a.best_id AS a_id, b.best_id AS b_id FROM a JOIN b USING (entry_key)
)
SELECT entry_key, same_season_status, same_season_reason, CASE WHEN retry THEN bs ELSE 'not_attempted' END AS fallback_status,
  CASE WHEN retry AND bs = 'resolved' THEN 'resolved' ELSE same_season_status END AS status,
  CASE WHEN retry AND bs = 'resolved' THEN 'next_season_fallback' WHEN same_season_status = 'resolved' THEN 'same_season' ELSE 'none' END AS match_strategy,
  CAST(CASE WHEN retry AND bs = 'resolved' THEN 2025 WHEN same_season_status = 'resolved' THEN 2024 END AS INTEGER) AS roster_match_season,
  CASE WHEN retry AND bs = 'resolved' THEN b_id WHEN same_season_status IN ('resolved', 'review') THEN a_id END AS player_id
FROM s"""


@query("r04_resolve_fallback", _STATES)
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = resolve.resolve_with_fallback(entries(spark, sf_dir), roster(spark, sf_dir), edit_ratio)
    return t.select("entry_key", "same_season_status", "same_season_reason", "fallback_status", "status", "match_strategy", "roster_match_season", "player_id")


@query("r04_resolve_fallback_all")
def fallback_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an entry, against every part as a roster row."""
    return resolve.resolve_with_fallback(entries(spark, sf_dir), roster(spark, sf_dir), edit_ratio)


_ACC = "count(*) AS n, CAST(count(*) FILTER (status = 'resolved') AS BIGINT) AS resolved, CAST(count(*) FILTER (status <> 'resolved') AS BIGINT) AS held_out"


@query("a01_accounting", f"WITH {RESOLVE_SQL} SELECT reason, {_ACC}, CAST(count(*) FILTER (status = 'resolved') AS DOUBLE) / count(*) AS resolved_rate FROM decided WHERE y = 2024 GROUP BY reason")
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.accounting(resolve.resolve(entries(spark, sf_dir), roster(spark, sf_dir), edit_ratio), "reason")


@query("a02_j10_share", "SELECT c_nationkey, c_mktsegment, n, CAST(total AS BIGINT) AS total, n / CAST(total AS DOUBLE) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL))")
def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counts_with_share(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"])


@query("o03_sample", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('20260821|' || c_custkey), c_custkey) AS k FROM customer) WHERE k <= 25")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stratified_sample(table(spark, sf_dir, "customer"), "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")


_OUT = "CASE WHEN o_orderkey % 23 = 0 THEN 'uncertain' WHEN o_orderkey % 7 = 0 THEN 'incorrect' ELSE 'Correct' END"
_LABELS = f"""x AS (SELECT o_orderpriority AS g, lower({_OUT}) AS o FROM orders WHERE o_orderstatus = 'F'), c AS (
  SELECT g, count(*) AS n, count(*) FILTER (o = 'correct') AS c, count(*) FILTER (o = 'incorrect') AS i, count(*) FILTER (o = 'uncertain') AS u FROM x GROUP BY g
), p AS (SELECT o_orderpriority AS g, count(*) AS pn FROM orders GROUP BY 1), w AS (
  SELECT CAST(sum(pn) AS DOUBLE) AS pop, sum(pn * (c / n)) / sum(pn) AS s, coalesce(sum(pn * (c / nullif(c + i, 0))), 0) / sum(pn) AS a, sum(pn * ((c + u) / n)) / sum(pn) AS q,
    CAST(sum(pn) AS DOUBLE) * sum(pn) / sum(pn * pn / n) AS e FROM c JOIN p USING (g)
)"""
_Z = "1.959963984540054"
_MID = f"(s + {_Z} * {_Z} / (2 * e)) / (1 + {_Z} * {_Z} / e)"
_HALF = f"{_Z} / (1 + {_Z} * {_Z} / e) * sqrt(s * (1 - s) / e + {_Z} * {_Z} / (4 * e * e))"


def labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels of finished orders, as an estimate for all orders of their priority."""
    o = table(spark, sf_dir, "orders")
    population = o.groupBy(F.col("o_orderpriority").alias("g")).agg(F.count("*").alias("population_n"))
    return o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("g"), F.expr(_OUT).alias("label_outcome")), population


@query(
    "a17_a19_precision",
    f"""WITH {_LABELS} SELECT CAST(pop AS BIGINT) AS population, round(s, 9) AS strict_rate, round(a, 9) AS adjudicated_rate, round(q, 9) AS possible_rate, round(e, 6) AS effective_n,
    round(greatest(0.0, {_MID} - {_HALF}), 9) AS strict_low, round(least(1.0, {_MID} + {_HALF}), 9) AS strict_high FROM w""",
)
def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, population = labels(spark, sf_dir)
    t = audit.weighted_precision(rows, population, "g")
    rates = [F.round(c, 9).alias(c) for c in ("strict_rate", "adjudicated_rate", "possible_rate", "strict_low", "strict_high")]
    return t.select("population", *rates, F.round("effective_n", 6).alias("effective_n"))


@query(
    "a20_e07_combined",
    f"""WITH {_LABELS}, f AS (SELECT count(*) AS n, count(*) FILTER ({_OUT} = 'Correct') AS c FROM orders WHERE o_orderstatus = 'P')
    SELECT round((pop * s + c) / (pop + n), 9) AS combined_rate, round((pop * greatest(0.0, {_MID} - {_HALF}) + c) / (pop + n), 9) AS combined_low, round(c / n, 9) AS census_rate FROM w, f""",
)
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, population = labels(spark, sf_dir)
    census = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.expr(_OUT).alias("label_outcome"))
    t = audit.combined_precision(audit.weighted_precision(rows, population, "g"), census)
    return t.select(*[F.round(c, 9).alias(c) for c in ("combined_rate", "combined_low", "census_rate")])


@query(
    "a21_j09_accuracy",
    f"""WITH {RESOLVE_SQL}, p AS (SELECT entry_key, coalesce(CASE WHEN status IN ('resolved', 'review') THEN best_id END, '') AS f, substr(entry_key, 2) AS x FROM decided WHERE y = 2024)
    SELECT count(*) AS labelled, CAST(count(*) FILTER (f = x AND f <> '') AS BIGINT) AS correct, CAST(count(*) FILTER (f <> '' AND f <> x) AS BIGINT) AS false_positive,
    CAST(count(*) FILTER (f = '' AND x <> '') AS BIGINT) AS false_negative, count(*) FILTER (f = x AND f <> '') / count(*) AS accuracy FROM p""",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir)
    known = e.withColumn("expected_player_id", F.expr("substr(entry_key, 2)")).withColumn("ordinal", F.lit(1))
    return audit.labelled_accuracy(resolve.resolve(e, roster(spark, sf_dir), edit_ratio), known)


@query(
    "a21_j09_by_name",
    """SELECT 'odd' AS status, count(*) FILTER (o_orderkey % 2 = 1) AS n FROM orders UNION ALL SELECT 'even', count(*) FILTER (o_orderkey % 2 = 0) FROM orders""",
)
def accuracy_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a key: names meet whatever their case and the blanks around them."""
    o = table(spark, sf_dir, "orders").select(
        F.lit(" ").alias("entry_key"), F.lit(2024).alias("season"), F.concat(F.lit(" Name "), "o_orderkey").alias("first_name"), F.lit("Last ").alias("last_name"),
        F.lit(None).cast("string").alias("origin"), F.lit("TEAM").alias("destination"), F.col("o_orderkey").cast("string").alias("player_id"),
        F.when(F.col("o_orderkey") % 2 == 1, F.lit("odd")).otherwise(F.lit("even")).alias("status"),
    )
    known = o.withColumns(
        {"first_name": F.upper("first_name"), "last_name": F.lit("last"), "destination": F.lit(" team "), "expected_player_id": F.col("player_id"), "ordinal": F.lit(1)}
    )
    return audit.labelled_status(o, known)


@query("g09_label_conflicts", "SELECT CAST(count(*) FILTER (o_orderkey % 31 = 0) AS BIGINT) AS unknown_outcome, CAST(count(*) FILTER (o_orderkey % 31 <> 0 AND o_orderkey % 5 = 0) AS BIGINT) AS correct_but_different, CAST(0 AS BIGINT) AS uncertain_with_id FROM orders")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 31 == 0, F.lit("?")).otherwise(F.lit("correct")).alias("label_outcome"),
        F.col("o_orderkey").cast("string").alias("predicted_player_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string")).alias("expected_player_id"),
    )
    return audit.label_conflicts(o)


_STATS = """stats AS (
  SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderpriority AS team, o_orderstatus AS category, count(*) AS cnt, round(sum(o_totalprice), 2) AS amt
  FROM orders GROUP BY ALL
), links AS (
  SELECT concat(o_custkey, '-', season) AS entry_key, o_custkey AS player_id, season, CASE WHEN o_custkey % 2 = 0 THEN '1-URGENT' ELSE '3-MEDIUM' END AS origin,
    CASE WHEN o_custkey % 3 = 0 THEN '2-HIGH' ELSE '5-LOW' END AS destination FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS season FROM orders)
  UNION ALL SELECT concat(c_custkey, '-2002'), c_custkey, 2002, '1-URGENT', '5-LOW' FROM customer WHERE c_custkey % 10 = 0
)"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("category")
    ).agg(F.count("*").alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("amt"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("season")).distinct()
    seen = o.select(
        F.concat_ws("-", "o_custkey", "season").alias("entry_key"),
        F.col("o_custkey").alias("player_id"),
        "season",
        F.when(F.col("o_custkey") % 2 == 0, F.lit("1-URGENT")).otherwise(F.lit("3-MEDIUM")).alias("origin"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("2-HIGH")).otherwise(F.lit("5-LOW")).alias("destination"),
    )
    later = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(
        F.concat(F.col("c_custkey"), F.lit("-2002")).alias("entry_key"), F.col("c_custkey").alias("player_id"), F.lit(2002).alias("season"),
        F.lit("1-URGENT").alias("origin"), F.lit("5-LOW").alias("destination"),
    )
    return seen.unionByName(later)


_BRIDGE = f"""{_STATS}, years AS (SELECT DISTINCT season FROM stats), b AS (
  SELECT l.*, l.season - 1 IN (SELECT season FROM years) AS pre_source_available, l.season IN (SELECT season FROM years) AS post_source_available,
    (SELECT count(*) FROM stats s WHERE s.player_id = l.player_id AND s.season = l.season - 1) AS pre_stat_row_count,
    (SELECT count(*) FROM stats s WHERE s.player_id = l.player_id AND s.season = l.season) AS post_stat_row_count,
    (SELECT count(*) FROM stats s WHERE s.player_id = l.player_id AND s.season = l.season - 1 AND s.team = l.origin) AS pre_expected_row_count,
    (SELECT count(*) FROM stats s WHERE s.player_id = l.player_id AND s.season = l.season AND s.team = l.destination) AS post_expected_row_count
  FROM links l
)"""


@query(
    "b01_j03_j04_bridge",
    f"""WITH {_BRIDGE} SELECT entry_key, pre_source_available, post_source_available, pre_stat_row_count, post_stat_row_count, pre_expected_row_count, post_expected_row_count,
    pre_stat_row_count > 0 AND pre_expected_row_count = 0 AS pre_team_mismatch, pre_expected_row_count > 0 AND post_expected_row_count > 0 AS complete_pre_post, NOT post_source_available AS post_outcome_right_censored FROM b""",
)
def season_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.season_bridge(links(spark, sf_dir), stats(spark, sf_dir))
    return t.select("entry_key", "pre_source_available", "post_source_available", "pre_stat_row_count", "post_stat_row_count", "pre_expected_row_count", "post_expected_row_count", "pre_team_mismatch", "complete_pre_post", "post_outcome_right_censored")


@query(
    "a03_bridge_summary",
    f"""WITH {_BRIDGE} SELECT season, count(*) AS n, CAST(count(*) FILTER (pre_stat_row_count > 0) AS BIGINT) AS pre_has_stats, CAST(count(*) FILTER (pre_expected_row_count > 0 AND post_expected_row_count > 0) AS BIGINT) AS complete_pre_post,
    CAST(count(*) FILTER (NOT post_source_available) AS BIGINT) AS post_outcome_right_censored FROM b GROUP BY season""",
)
def bridge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bridge.summary(bridge.season_bridge(links(spark, sf_dir), stats(spark, sf_dir)))
    return t.select("season", "n", "pre_has_stats", "complete_pre_post", "post_outcome_right_censored")


def long_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked rows of the expected teams, one per statistic, the value as text."""
    s = stats(spark, sf_dir).withColumn("stat", F.explode(F.array(F.struct(F.lit("AMT").alias("stat_type"), F.col("amt").cast("decimal(18,2)").cast("string").alias("v")), F.struct(F.lit("CNT").alias("stat_type"), F.col("cnt").cast("string").alias("v")))))
    s = s.select("player_id", "season", "team", "category", F.col("stat.stat_type").alias("stat_type"), F.col("stat.v").alias("stat"))
    return bridge.linked_stats(links(spark, sf_dir), s)


_FEATURES = [f"{p}_{c}_{s}" for p in ("pre", "post") for c in ("f", "o", "p") for s in ("amt", "cnt")]
_LONG = f"""{_STATS}, j AS (
  SELECT l.entry_key, 'pre' AS phase, s.* FROM links l JOIN stats s ON s.player_id = l.player_id AND s.season = l.season - 1 AND s.team = l.origin
  UNION ALL SELECT l.entry_key, 'post', s.* FROM links l JOIN stats s ON s.player_id = l.player_id AND s.season = l.season AND s.team = l.destination
)"""
_PIVOT = ", ".join(f"max({s}) FILTER (phase = '{p}' AND lower(category) = '{c}') AS {p}_{c}_{s}" for p in ("pre", "post") for c in ("f", "o", "p") for s in ("amt",))


@query("p02_linked_stats", f"WITH {_LONG} SELECT phase, category, count(*) * 2 AS n, CAST(sum(CAST(amt AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM j GROUP BY ALL")
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = long_stats(spark, sf_dir)
    return t.groupBy("phase", "category").agg(F.count("*").alias("n"), F.sum(F.when(F.col("stat_type") == "AMT", F.col("stat").cast("decimal(18,2)"))).cast("double").alias("total"))


@query("a06_b02_pivot", f"WITH {_LONG}, p AS (SELECT entry_key, {_PIVOT} FROM j GROUP BY entry_key) SELECT l.entry_key, p.* EXCLUDE (entry_key) FROM links l LEFT JOIN p USING (entry_key)")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s = links(spark, sf_dir), stats(spark, sf_dir)
    values = features.named_values(long_stats(spark, sf_dir))
    t = features.matrix(bridge.season_bridge(l, s), values, _FEATURES)
    return t.select("entry_key", *[f for f in _FEATURES if f.endswith("_amt")])


@query(
    "j06_has_features",
    f"WITH {_LONG}, p AS (SELECT DISTINCT entry_key FROM j) SELECT l.entry_key, p.entry_key IS NOT NULL AS has_features, CASE WHEN p.entry_key IS NULL THEN 'missing_feature_row' END AS reason FROM links l LEFT JOIN p USING (entry_key)",
)
def has_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bridge rows have any feature; the others are excluded with a reason."""
    t = features.matrix(bridge.season_bridge(links(spark, sf_dir), stats(spark, sf_dir)), features.named_values(long_stats(spark, sf_dir)), _FEATURES)
    t = t.withColumns({"match_strategy": F.lit("same_season"), "model_group": F.lit("QB"), "season": F.lit(2021), "post_anchor": F.lit(None).cast("double"), "post_outcome_right_censored": F.lit(False)})
    return cohorts.observability(t).select("entry_key", "has_features", F.col("exclusion_reason").alias("reason"))


@query("a07_conflicts", "SELECT l_orderkey, l_linenumber, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING min(l_quantity) <> max(l_quantity)")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_quantity")


@query("j05_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("entry_key"))
    return features.orphans(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "entry_key"), c).select("o_orderkey")


@query("a05_team_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT trim(o_orderpriority))), ',') AS teams FROM orders GROUP BY o_custkey")
def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.trim("o_orderpriority"))), ",").alias("teams"))


@query("w05_lag", f"WITH {base.SEASONS_SQL} SELECT a.cust, a.season, a.amt, b.amt AS amt_s2 FROM seasons a LEFT JOIN seasons b ON a.cust = b.cust AND a.season = b.season + 2")
def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.lag_by_season(base.seasons(spark, sf_dir).select("cust", "season", "amt"), ["cust"], "amt", 2)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.with_targets(base.wide(spark, sf_dir), "position", base.TARGETS)


@query(
    "b03_p04_p05_cohort_v1",
    f"""WITH {base.WIDE_SQL} SELECT entry_key, model_group, target_metric, pre_anchor, post_anchor, post_anchor - pre_anchor AS target_delta,
    CASE WHEN target_metric IS NULL THEN 'unsupported_position_target' WHEN pre_anchor IS NULL THEN 'missing_pre_anchor' WHEN post_anchor IS NULL THEN 'missing_post_anchor' END AS exclusion_reason FROM t""",
)
def cohort_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cohorts.modelling_both_anchors(_targets(spark, sf_dir))
    return t.select("entry_key", "model_group", "target_metric", "pre_anchor", "post_anchor", "target_delta", "exclusion_reason")


@query(
    "b04_p06_cohort_v2",
    f"""WITH {base.WIDE_SQL} SELECT entry_key, pre_anchor IS NULL AS baseline_missing, pre_amt IS NULL AS missing_pre_amt, pre_cnt IS NULL AS missing_pre_cnt,
    CAST((pre_amt IS NULL)::INT + (pre_cnt IS NULL)::INT AS INTEGER) AS feature_missing_count, CAST(2 - (pre_amt IS NULL)::INT - (pre_cnt IS NULL)::INT AS INTEGER) AS feature_observed_count,
    CASE WHEN post_outcome_right_censored THEN 'post_outcome_right_censored' WHEN target_metric IS NULL THEN 'unsupported_position_target' WHEN post_anchor IS NULL THEN 'missing_post_target' END AS exclusion_reason FROM t""",
)
def cohort_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features.with_missing_flags(cohorts.modelling_outcome_observed(_targets(spark, sf_dir)), ["pre_amt", "pre_cnt"])
    return t.select("entry_key", "baseline_missing", "missing_pre_amt", "missing_pre_cnt", "feature_missing_count", "feature_observed_count", "exclusion_reason")


@query(
    "b05_j07_control_panel",
    f"""WITH {base.WIDE_SQL}, h AS (SELECT CAST(cust AS VARCHAR) AS p, season + 2 AS season, 'amt' AS m, amt AS v FROM seasons UNION ALL SELECT CAST(cust AS VARCHAR), season + 2, 'cnt', cnt FROM seasons)
    SELECT entry_key, v AS s2_anchor, pre_anchor - v AS prior_change, CASE WHEN t.season < 1998 THEN 's2_source_unavailable' WHEN target_metric IS NULL THEN 'unsupported_target_metric'
    WHEN pre_anchor IS NULL THEN 'missing_s1_anchor' WHEN v IS NULL THEN 'missing_s2_anchor' END AS exclusion_reason FROM t LEFT JOIN h ON p = player_id AND h.season = t.season AND m = target_metric""",
)
def control_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_rows(spark, sf_dir).select("entry_key", "s2_anchor", "prior_change", "exclusion_reason")


def control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = base.seasons(spark, sf_dir)
    history = s.select(F.col("cust").cast("string").alias("player_id"), "season", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("amt", "cnt")])).alias("h")).select("player_id", "season", "h.metric", "h.value")
    return cohorts.negative_control(_targets(spark, sf_dir), history, 1998)


@query(
    "b06_observability",
    f"""WITH {base.WIDE_SQL} SELECT entry_key, CAST(post_anchor IS NOT NULL AS INTEGER) AS target_observed, pre_anchor, CASE WHEN season < 1997 OR season > 2000 THEN 'outside_seasons' WHEN match_strategy <> 'same_season' THEN 'not_same_season_roster_link'
    WHEN post_outcome_right_censored THEN 'post_stats_source_unavailable' WHEN position NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'unsupported_position' END AS exclusion_reason FROM t""",
)
def observability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cohorts.assert_no_leak(cohorts.observability(_targets(spark, sf_dir), 2000, 1997, ("BUILDING", "MACHINERY", "AUTOMOBILE")))
    return t.select("entry_key", "target_observed", "pre_anchor", "exclusion_reason")


@query(
    "b07_scoring",
    f"""WITH {base.WIDE_SQL} SELECT entry_key, model_group, CASE WHEN target_metric IS NULL THEN 'unsupported_position_target' WHEN model_group NOT IN ('BUILDING', 'MACHINERY') THEN 'insufficient_validation_evidence' END AS exclusion_reason
    FROM t WHERE season = 2001""",
)
def scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.scoring(_targets(spark, sf_dir), 2001, ("BUILDING", "MACHINERY")).select("entry_key", "model_group", "exclusion_reason")


@query(
    "b08_g07_support",
    f"""WITH {base.WIDE_SQL}, x AS (SELECT CASE WHEN pre_anchor IS NULL THEN 'LIMITED' WHEN post_cnt <= 2 THEN 'STRONG' ELSE 'STANDARD' END AS forecast_support, model_group FROM t)
    SELECT model_group, forecast_support, count(*) AS n FROM x GROUP BY ALL""",
)
def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, why = cohorts.support(F.col("pre_anchor").isNull().cast("string"), F.col("post_cnt").cast("int"))
    t = _targets(spark, sf_dir).withColumns({"forecast_support": label, "forecast_support_reason": why})
    return t.groupBy("model_group", "forecast_support").agg(F.count("*").alias("n"))
