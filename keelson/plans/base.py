"""Tables that the queries share, built from the driver's: a customer is an entity, a year of orders a season, a market
segment a group, the value and number of orders its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

TARGETS = {"BUILDING": "amt", "AUTOMOBILE": "amt", "MACHINERY": "cnt", "HOUSEHOLD": "cnt"}
CENSORED = 2001

SEASONS_SQL = """seasons AS (
  SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS season, round(sum(o_totalprice), 2) AS amt, CAST(count(*) AS DOUBLE) AS cnt
  FROM orders GROUP BY 1, 2
)"""
WIDE_SQL = f"""{SEASONS_SQL}, wide AS (
  SELECT concat(s.cust, '-', s.season) AS entry_key, CAST(s.cust AS VARCHAR) AS player_id, s.season, c_mktsegment AS position, c_acctbal AS rating, CAST(c_nationkey AS VARCHAR) AS destination,
    p.amt AS pre_amt, p.cnt AS pre_cnt, s.amt AS post_amt, s.cnt AS post_cnt, s.season >= {CENSORED} AS post_outcome_right_censored,
    CASE WHEN s.cust % 10 = 3 THEN 'next_season_fallback' ELSE 'same_season' END AS match_strategy
  FROM seasons s JOIN customer ON c_custkey = s.cust LEFT JOIN seasons p ON p.cust = s.cust AND p.season = s.season - 1
), t AS (
  SELECT *, position AS model_group,
    CASE WHEN position IN ('BUILDING', 'AUTOMOBILE') THEN 'amt' WHEN position IN ('MACHINERY', 'HOUSEHOLD') THEN 'cnt' END AS target_metric,
    CASE WHEN position IN ('BUILDING', 'AUTOMOBILE') THEN pre_amt WHEN position IN ('MACHINERY', 'HOUSEHOLD') THEN pre_cnt END AS pre_anchor,
    CASE WHEN position IN ('BUILDING', 'AUTOMOBILE') THEN post_amt WHEN position IN ('MACHINERY', 'HOUSEHOLD') THEN post_cnt END AS post_anchor
  FROM wide
)"""
MODEL_SQL = f"""{WIDE_SQL}, m AS (
  SELECT entry_key, season, model_group, post_anchor AS target, pre_anchor AS prior, pre_amt, pre_cnt, rating,
    CASE WHEN post_anchor > 200000 OR (target_metric = 'cnt' AND post_anchor > 1) THEN 1 ELSE 0 END AS observed
  FROM t WHERE NOT post_outcome_right_censored AND target_metric IS NOT NULL
)"""


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("season")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("amt"), F.count("*").cast("double").alias("cnt")
    )


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seasons(spark, sf_dir)
    prior = s.select("cust", (F.col("season") + 1).alias("season"), F.col("amt").alias("pre_amt"), F.col("cnt").alias("pre_cnt"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("position"), F.col("c_acctbal").alias("rating"), F.col("c_nationkey").cast("string").alias("destination"))
    t = s.join(c, "cust").join(prior, ["cust", "season"], "left")
    return t.select(
        F.concat_ws("-", "cust", "season").alias("entry_key"),
        F.col("cust").cast("string").alias("player_id"),
        "season",
        "position",
        "rating",
        "destination",
        "pre_amt",
        "pre_cnt",
        F.col("amt").alias("post_amt"),
        F.col("cnt").alias("post_cnt"),
        (F.col("season") >= CENSORED).alias("post_outcome_right_censored"),
        F.when(F.col("cust") % 10 == 3, F.lit("next_season_fallback")).otherwise(F.lit("same_season")).alias("match_strategy"),
    )


def modelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an observed target: target, prior value, predictors and a 0/1 outcome."""
    from ..operators.cohorts import with_targets

    t = with_targets(wide(spark, sf_dir), "position", TARGETS).where(~F.col("post_outcome_right_censored") & F.col("target_metric").isNotNull())
    high = (F.col("post_anchor") > 200000) | ((F.col("target_metric") == "cnt") & (F.col("post_anchor") > 1))
    return t.select(
        "entry_key", "season", "model_group", F.col("post_anchor").alias("target"), F.col("pre_anchor").alias("prior"), "pre_amt", "pre_cnt", "rating",
        high.cast("int").alias("observed"),
    )
