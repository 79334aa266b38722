"""Metrics, preprocessing, models and evaluations as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..operators import metrics as M
from ..operators import models
from ..operators import windows as W
from ..operators.medians import expanding_medians
from . import base
from .entity_queries import control_rows
from .registry import query, table

YEARS = [1998, 1999, 2000]
COLUMNS = ["pre_amt", "pre_cnt", "rating"]
#: Predictors of each group, of different number and order.
OWN = {"BUILDING": ["pre_amt", "rating"], "AUTOMOBILE": ["pre_cnt"], "MACHINERY": ["rating", "pre_cnt", "pre_amt"], "HOUSEHOLD": ["pre_cnt", "pre_amt"]}

_PROB = """s AS (
  SELECT d.doc_id, d.lang, l.quality AS y, round(1 / (1 + exp(-(d.n_chars - 2000) / 1500.0)), 3) AS p FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null")
    return d.join(l, "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), F.round(1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 1500.0)), 3).alias("p"))


@query(
    "a12_regression",
    """WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS y, o_totalprice * 0.9 + 1000 AS p FROM orders), m AS (SELECT g, avg(y) AS a FROM x GROUP BY g)
    SELECT g, count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - sum((p - y) * (p - y)) / sum((y - a) * (y - a)), 8) AS r2 FROM x JOIN m USING (g) GROUP BY g""",
)
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + 1000).alias("p"))
    t = M.regression(x, ["g"], "y", "p")
    return t.select("g", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"))


@query(
    "a14_a15_probability",
    f"""WITH {_PROB} SELECT lang, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 8) AS prevalence, round(avg((p - y) * (p - y)), 8) AS brier,
    round(avg(-(y * ln(greatest(1e-9, least(1 - 1e-9, p))) + (1 - y) * ln(1 - greatest(1e-9, least(1 - 1e-9, p))))), 7) AS log_loss FROM s GROUP BY lang""",
)
def probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.probability(scored(spark, sf_dir), ["lang"], "y", "p")
    return t.select("lang", "n", "positives", F.round("prevalence", 8).alias("prevalence"), F.round("brier", 8).alias("brier"), F.round("log_loss", 7).alias("log_loss"))


@query(
    "w02_auc",
    f"""WITH {_PROB} SELECT a.lang, count(*) FILTER (b.y = 0 AND a.y = 1) AS pairs, round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*), 8) AS roc_auc
    FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang""",
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.roc_auc(scored(spark, sf_dir), ["lang"], "y", "p").where("roc_auc is not null")
    return t.select("lang", (F.col("positives") * (F.col("n") - F.col("positives"))).alias("pairs"), F.round("roc_auc", 8).alias("roc_auc"))


@query(
    "w03_average_precision",
    f"""WITH {_PROB}, k AS (SELECT lang, y, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM s WINDOW w AS (PARTITION BY lang ORDER BY p DESC, doc_id))
    SELECT lang, count(*) AS n, round(sum(CASE WHEN y = 1 THEN tp / k END) / sum(y), 8) AS average_precision FROM k GROUP BY lang""",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.average_precision(scored(spark, sf_dir), ["lang"], "y", "p", "doc_id")
    return t.select("lang", "n", F.round("average_precision", 8).alias("average_precision"))


@query(
    "a16_reliability",
    f"""WITH {_PROB}, b AS (SELECT least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS observed FROM s GROUP BY 1)
    SELECT CAST(g AS INTEGER) AS bin, coalesce(n, 0) AS n, mean_p, observed FROM range(10) r(g) LEFT JOIN b ON bin = g""",
)
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.reliability(scored(spark, sf_dir), "y", "p")
    return t.select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("observed", 8).alias("observed"))


@query("m10_m11_calibration")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.calibration(scored(spark, sf_dir), ["lang"], "y", "p")


@query("a22_argmin", "WITH x AS (SELECT p_brand AS g, p_size AS a, round(avg(p_retailprice), 2) AS s FROM part GROUP BY ALL) SELECT g, a, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, a) AS k FROM x) WHERE k = 1")
def argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("g"), F.col("p_size").alias("a")).agg(F.round(F.avg("p_retailprice"), 2).alias("s"))
    return M.best_of_grid(x, ["g"], "a", "s")


_FEATURE_STATS = ", ".join(f"coalesce(median({c}), 0) AS m_{c}" for c in COLUMNS)


@query(
    "a08_a09_m01_preprocess",
    f"""WITH {base.MODEL_SQL}, tr AS (SELECT * FROM m WHERE season < 1999), med AS (SELECT model_group, {_FEATURE_STATS} FROM tr GROUP BY 1),
    st AS (SELECT tr.model_group, {', '.join(f'avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}' for c in COLUMNS)} FROM tr JOIN med USING (model_group) GROUP BY 1)
    SELECT entry_key, {', '.join(f'round((coalesce({c}, m_{c}) - a_{c}) / CASE WHEN s_{c} < 1e-12 THEN 1 ELSE s_{c} END, 6) AS z_{c}, CAST({c} IS NULL AS INTEGER) AS miss_{c}' for c in COLUMNS)}
    FROM m JOIN med USING (model_group) JOIN st USING (model_group) WHERE season = 1999""",
)
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base.modelling(spark, sf_dir)
    t = M.preprocess(m.where("season = 1999"), m.where("season < 1999"), ["model_group"], COLUMNS)
    return t.select("entry_key", *[c for x in COLUMNS for c in (F.round(f"z_{x}", 6).alias(f"z_{x}"), f"miss_{x}")])


@query(
    "a11_gram",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_quantity), 2) AS xx_q_q, round(sum(l_quantity * l_discount), 4) AS xx_q_d, round(sum(l_discount * l_discount), 4) AS xx_d_d,
    round(sum(l_quantity * l_tax), 4) AS xy_q, round(sum(l_discount * l_tax), 4) AS xy_d, round(sum(l_tax), 4) AS sum_y FROM lineitem GROUP BY 1""",
)
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), "l_tax")
    t = M.gram(l, ["l_returnflag"], ["q", "d"], "l_tax")
    return t.select("l_returnflag", "n", *[F.round(c, 2 if c == "xx_q_q" else 4).alias(c) for c in t.columns[2:]])


_FOLDS = f"""{base.MODEL_SQL}, y(holdout_year) AS (VALUES (1998), (1999), (2000)), f AS (
  SELECT *, season < holdout_year AS train FROM m JOIN y ON season <= holdout_year
), st AS (
  SELECT holdout_year, model_group, CAST(count(*) FILTER (train) AS BIGINT) AS train_rows, CAST(count(*) FILTER (NOT train) AS BIGINT) AS holdout_rows FROM f GROUP BY ALL
), st2 AS (SELECT *, CASE WHEN train_rows >= 40 AND holdout_rows >= 20 THEN 'evaluated' ELSE 'skipped_low_sample' END AS status FROM st),
h AS (
  SELECT f.*, (SELECT avg(target) FROM f f2 WHERE f2.train AND f2.holdout_year = f.holdout_year AND f2.model_group = f.model_group) AS historical_mean
  FROM f JOIN st2 USING (holdout_year, model_group) WHERE NOT train AND status = 'evaluated'
)"""


@query("e02_fold_status", f"WITH {_FOLDS} SELECT * FROM st2")
def fold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fold_status(B.folds(base.modelling(spark, sf_dir), YEARS), B.ROLLING)


@query(
    "e02_baselines",
    f"""WITH {_FOLDS} SELECT holdout_year, model_group, count(*) AS n, round(avg(abs(historical_mean - target)), 4) AS historical_mae, CAST(count(prior) AS BIGINT) AS paired_n,
    round(avg(abs(historical_mean - target)) FILTER (prior IS NOT NULL), 4) AS paired_historical_mae, round(avg(abs(prior - target)), 4) AS returning_mae FROM h GROUP BY ALL""",
)
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = B.folds(base.modelling(spark, sf_dir), YEARS)
    t = B.baseline_metrics(B.baselines(folded, B.fold_status(folded, B.ROLLING), "target", "prior"), "target")
    return t.select("holdout_year", "model_group", "n", "paired_n", *[F.round(c, 4).alias(c) for c in ("historical_mae", "paired_historical_mae", "returning_mae")])


@query("e02_rolling_ridge")
def rolling_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling folds: penalty by inner years, ridge, both baselines, errors and skills per fold."""
    return B.evaluate(B.rolling_ridge(base.modelling(spark, sf_dir), YEARS, COLUMNS, "target", "prior"), "target")


_SEASONS = ", ".join(f"({y})" for y in range(1992, 2004))


@query(
    "a08_m01_window_medians",
    f"""WITH {base.MODEL_SQL}, y(year) AS (VALUES {_SEASONS}) SELECT model_group, year, {', '.join(f'round(median({c}), 6) AS {c}' for c in COLUMNS)}
    FROM m JOIN y ON season < year GROUP BY ALL""",
)
def window_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of all expanding windows of each group, from counts that the windows share."""
    t = expanding_medians(base.modelling(spark, sf_dir), ["model_group"], [F.col(c) for c in COLUMNS], "season", list(range(1992, 2004)))
    return t.select("model_group", "year", *[F.round(F.get("medians", F.lit(i)), 6).alias(c) for i, c in enumerate(COLUMNS)])


@query(
    "e02_own_vectors",
    f"""WITH {base.MODEL_SQL} SELECT entry_key, CASE model_group {' '.join(f"WHEN '{g}' THEN [{', '.join(f'CAST({c} AS DOUBLE)' for c in cs)}]" for g, cs in OWN.items())} END AS x FROM m""",
)
def own_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's own predictors in its own order, missing ones as null."""
    return base.modelling(spark, sf_dir).select("entry_key", W.vector(OWN).alias("x"))


@query(
    "e02_own_moments",
    f"""WITH {base.MODEL_SQL}, x AS (
      SELECT *, CASE model_group WHEN 'BUILDING' THEN pre_amt WHEN 'AUTOMOBILE' THEN pre_cnt WHEN 'MACHINERY' THEN rating ELSE pre_cnt END AS p FROM m
    ) SELECT model_group, season, count(*) AS n, round(sum(coalesce(p, 0) - CASE WHEN p IS NULL THEN 0 ELSE 10 END), 2) AS sum_v, round(min(p) - 10, 2) AS low, round(max(p) - 10, 2) AS high
    FROM x GROUP BY ALL""",
)
def own_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each group and season that all windows are made of; here the first predictor's, shifted by 10."""
    rows = base.modelling(spark, sf_dir)
    shifts = rows.select("model_group").distinct().withColumn("shift", F.array(*[F.lit(10.0)] * W.width(OWN)))
    t = W.moments(rows, shifts, OWN, "target")
    one = lambda c, i: F.round(F.get(c, F.lit(i)), 2)
    return t.select("model_group", "season", "n", one("products", 1).alias("sum_v"), one("low", 0).alias("low"), one("high", 0).alias("high"))


@query("e02_own_predictors")
def own_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``e02_rolling_ridge`` with each group's own predictors, all groups in one plan."""
    return B.evaluate(B.rolling_ridge(base.modelling(spark, sf_dir), YEARS, OWN, "target", "prior"), "target")


_ONE = {"BUILDING": "pre_amt", "AUTOMOBILE": "rating", "MACHINERY": "pre_cnt", "HOUSEHOLD": "rating"}


@query(
    "e02_m03_one_predictor",
    f"""WITH {_FOLDS}, x AS (
      SELECT f.*, CASE model_group {' '.join(f"WHEN '{g}' THEN {c}" for g, c in _ONE.items())} END AS p FROM f JOIN st2 USING (holdout_year, model_group) WHERE status = 'evaluated'
    ), d AS (SELECT holdout_year, model_group, coalesce(median(p), 0) AS med FROM x WHERE train GROUP BY ALL),
    i AS (SELECT x.*, coalesce(p, med) AS v FROM x JOIN d USING (holdout_year, model_group)),
    s AS (SELECT holdout_year, model_group, avg(v) AS a, CASE WHEN stddev_pop(v) < 1e-12 THEN 1 ELSE stddev_pop(v) END AS sd, avg(target) AS ty, count(*) AS n FROM i WHERE train GROUP BY ALL),
    b AS (SELECT holdout_year, model_group, sum((v - a) / sd * target) / (sum(power((v - a) / sd, 2)) + 10) AS beta FROM i JOIN s USING (holdout_year, model_group) WHERE train GROUP BY ALL)
    SELECT i.entry_key, i.holdout_year, i.model_group, round(ty + beta * (v - a) / sd, 4) AS prediction
    FROM i JOIN s USING (holdout_year, model_group) JOIN b USING (holdout_year, model_group) WHERE NOT train""",
)
def one_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge fit of one predictor for each group, another for each, which has a closed form in SQL."""
    own = {g: [c] for g, c in _ONE.items()}
    t = B.rolling_ridge(base.modelling(spark, sf_dir), YEARS, own, "target", "prior", flags=False, grid=(10.0,))
    return t.select("entry_key", "holdout_year", "model_group", F.round("prediction", 4).alias("prediction"))


@query("a28_wins")
def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.wins(rolling_ridge(spark, sf_dir), ["model_group"], "model_mae", "historical_mae")


@query(
    "a28_wins_mean",
    f"""WITH {_FOLDS}, e AS (SELECT model_group, holdout_year, avg(abs(historical_mean - target)) FILTER (prior IS NOT NULL) AS a, avg(abs(prior - target)) AS b FROM h GROUP BY ALL)
    SELECT model_group, count(*) AS folds, CAST(count(*) FILTER (a < b) AS BIGINT) AS wins FROM e GROUP BY model_group""",
)
def wins_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds in which the historical mean beats the prior value."""
    folded = B.folds(base.modelling(spark, sf_dir), YEARS)
    t = B.baseline_metrics(B.baselines(folded, B.fold_status(folded, B.ROLLING), "target", "prior"), "target")
    return M.wins(t, ["model_group"], "paired_historical_mae", "returning_mae")


@query("e01_holdout_ridge")
def holdout_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One strict holdout year on complete rows, without missing flags."""
    rows = base.modelling(spark, sf_dir).where("prior is not null")
    return B.evaluate(B.rolling_ridge(rows, [2000], COLUMNS, "target", "prior", B.HOLDOUT, flags=False), "target")


@query(
    "e01_baseline",
    f"""WITH {base.MODEL_SQL}, g AS (
      SELECT model_group, avg(target) FILTER (season < 2000) AS a, count(*) FILTER (season < 2000) AS t, count(*) FILTER (season = 2000) AS v FROM m WHERE prior IS NOT NULL GROUP BY 1
    ) SELECT 2000 AS holdout_year, model_group, count(*) AS n, round(avg(abs(a - target)), 4) AS historical_mae, round(avg(abs(prior - target)), 4) AS returning_mae
    FROM m JOIN g USING (model_group) WHERE season = 2000 AND prior IS NOT NULL AND t >= 50 AND v >= 10 GROUP BY 2""",
)
def holdout_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict holdout year is measured against: the training mean and the prior value."""
    folded = B.folds(base.modelling(spark, sf_dir).where("prior is not null"), [2000])
    t = B.baseline_metrics(B.baselines(folded, B.fold_status(folded, B.HOLDOUT), "target", "prior"), "target")
    return t.select("holdout_year", "model_group", "n", *[F.round(c, 4).alias(c) for c in ("historical_mae", "returning_mae")])


@query(
    "a10_j08_target_encoding",
    f"""WITH {base.MODEL_SQL}, tr AS (SELECT * FROM m WHERE season < 1999), k AS (SELECT rating > 5000 AS r, season % 2 AS s2, avg(target) AS a FROM tr GROUP BY ALL)
    SELECT entry_key, round(coalesce(k.a, (SELECT avg(target) FROM tr)), 3) AS signal FROM (SELECT *, season % 2 AS s2 FROM m WHERE season = 1999) x LEFT JOIN k ON k.r = (x.rating > 5000) AND k.s2 = x.s2 AND x.season <> 1999""",
)
def target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No key of the holdout year has been seen, so every row gets the mean of all training rows."""
    m = base.modelling(spark, sf_dir).withColumn("k", F.concat_ws("|", F.col("rating") > 5000, "season"))
    t = M.target_encoding(m.where("season = 1999"), m.where("season < 1999"), "k", "target")
    return t.select("entry_key", F.round("signal", 3).alias("signal"))


@query(
    "a10_j08_known_keys",
    f"""WITH {base.MODEL_SQL}, tr AS (SELECT * FROM m WHERE season < 1999 AND model_group <> 'MACHINERY'), k AS (SELECT model_group, rating > 5000 AS r, avg(target) AS a FROM tr GROUP BY ALL)
    SELECT entry_key, round(coalesce(k.a, (SELECT avg(target) FROM tr)), 3) AS signal FROM (SELECT * FROM m WHERE season = 1999) x
    LEFT JOIN k ON k.model_group = x.model_group AND k.r = (x.rating > 5000)""",
)
def known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that training has seen get their own mean, those of one segment, which it hasn't, the mean of all."""
    m = base.modelling(spark, sf_dir).withColumn("k", F.concat_ws("|", "model_group", F.col("rating") > 5000))
    t = M.target_encoding(m.where("season = 1999"), m.where("season < 1999 and model_group <> 'MACHINERY'"), "k", "target")
    return t.select("entry_key", F.round("signal", 3).alias("signal"))


_CONTROL = f"""{base.WIDE_SQL}, h AS (
  SELECT CAST(cust AS VARCHAR) AS p, season + 2 AS season, 'amt' AS m, amt AS v FROM seasons UNION ALL SELECT CAST(cust AS VARCHAR), season + 2, 'cnt', cnt FROM seasons
), f AS (
  SELECT entry_key, model_group, destination AS k, pre_anchor - v AS y, t.season < 2001 AS train
  FROM t JOIN h ON p = player_id AND h.season = t.season AND m = target_metric WHERE t.season BETWEEN 1998 AND 2001 AND pre_anchor IS NOT NULL
), g AS (SELECT model_group, avg(y) FILTER (train) AS whole, CAST(count(*) FILTER (train) AS BIGINT) AS train_rows, CAST(count(*) FILTER (NOT train) AS BIGINT) AS holdout_rows FROM f GROUP BY 1)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control_rows(spark, sf_dir).where("exclusion_reason is null")


@query(
    "e03_signal",
    f"""WITH {_CONTROL}, k AS (SELECT model_group, k, avg(y) AS a FROM f WHERE train GROUP BY ALL)
    SELECT entry_key, round(coalesce(a, whole), 3) AS signal FROM f JOIN g USING (model_group) LEFT JOIN k USING (model_group, k) WHERE NOT train""",
)
def control_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdout year's destinations, encoded by the changes of earlier years."""
    t = M.encode_in_folds(B.folds(panel(spark, sf_dir), [2001]), ["holdout_year", "model_group"], "destination", "prior_change")
    return t.where("part = 'holdout'").select("entry_key", F.round("signal", 3).alias("signal"))


@query(
    "e03_control_baseline",
    f"""WITH {_CONTROL}, e AS (SELECT model_group, avg(abs(y - whole)) AS mae FROM f JOIN g USING (model_group) WHERE NOT train GROUP BY 1)
    SELECT model_group, train_rows, holdout_rows, CASE WHEN train_rows >= 40 AND holdout_rows >= 10 THEN 'evaluated' ELSE 'skipped_low_sample' END AS status,
    CASE WHEN train_rows >= 40 AND holdout_rows >= 10 THEN round(mae, 4) END AS baseline_mae FROM g LEFT JOIN e USING (model_group)""",
)
def control_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = negative_control(spark, sf_dir)
    return t.select("model_group", "train_rows", "holdout_rows", "status", F.round("baseline_mae", 4).alias("baseline_mae"))


@query(
    "e03_signal_fit",
    f"""WITH {_CONTROL}, k AS (SELECT model_group, k, avg(y) AS a FROM f WHERE train AND trim(k) <> '' GROUP BY ALL),
    x AS (SELECT f.*, coalesce(k.a, whole) AS v FROM f JOIN g USING (model_group) LEFT JOIN k USING (model_group, k) WHERE train_rows >= 40 AND holdout_rows >= 10),
    s AS (SELECT model_group, avg(v) AS a, CASE WHEN stddev_pop(v) < 1e-12 THEN 1 ELSE stddev_pop(v) END AS sd, avg(y) AS ty FROM x WHERE train GROUP BY 1),
    b AS (SELECT model_group, sum((v - a) / sd * y) / (sum(power((v - a) / sd, 2)) + 10) AS beta FROM x JOIN s USING (model_group) WHERE train GROUP BY 1)
    SELECT entry_key, model_group, round(ty + beta * (v - a) / sd, 3) AS prediction FROM x JOIN s USING (model_group) JOIN b USING (model_group) WHERE NOT train""",
)
def control_signal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control's model on the signal alone with one penalty, which has a closed form in SQL."""
    t = B.negative_control(panel(spark, sf_dir), 2001, [], "destination", grid=(10.0,))[0]
    return t.select("entry_key", "model_group", F.round("prediction", 3).alias("prediction"))


@query("e03_own_predictors")
def own_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``e03_negative_control`` with each group's own predictors next to the signal."""
    return B.negative_control(panel(spark, sf_dir), 2001, {g: cs for g, cs in OWN.items() if g != "HOUSEHOLD"}, "destination")[1]


@query("e03_negative_control")
def negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the destination, known later, predict the change that came before? Encoded anew in every fold."""
    return B.negative_control(panel(spark, sf_dir), 2001, ["rating"], "destination")[1]


def probabilities(spark: SparkSession, sf_dir: str, years: list[int]) -> DataFrame:
    return B.rolling_logistic(base.modelling(spark, sf_dir), years, COLUMNS, "observed")


def _baseline_sql(years: list[int]) -> str:
    return f"""WITH {base.MODEL_SQL}, y(holdout_year) AS (VALUES {", ".join(f"({y})" for y in years)}), f AS (
      SELECT *, season < holdout_year AS train FROM m JOIN y ON season <= holdout_year
    ), st AS (
      SELECT holdout_year, model_group, CAST(count(*) FILTER (train) AS BIGINT) AS train_rows, CAST(count(*) FILTER (NOT train) AS BIGINT) AS holdout_rows,
        CAST(count(*) FILTER (train AND observed = 1) AS BIGINT) AS train_positives, CAST(count(*) FILTER (train AND observed = 0) AS BIGINT) AS train_negatives FROM f GROUP BY ALL
    ), s2 AS (
      SELECT *, CASE WHEN train_rows < 40 OR holdout_rows < 20 THEN 'skipped_low_sample' WHEN train_positives < 5 OR train_negatives < 5 THEN 'skipped_low_train_class_count' ELSE 'evaluated' END AS status FROM st
    ), b AS (
      SELECT holdout_year, model_group, avg(power(observed - train_positives / CAST(train_rows AS DOUBLE), 2)) AS brier FROM f JOIN st USING (holdout_year, model_group) WHERE NOT train GROUP BY ALL
    )
    SELECT holdout_year, model_group, train_rows, holdout_rows, train_positives, train_negatives, status,
      CASE WHEN status = 'evaluated' THEN round(train_positives / CAST(train_rows AS DOUBLE), 8) END AS train_prevalence, CASE WHEN status = 'evaluated' THEN round(brier, 8) END AS baseline_brier
    FROM s2 LEFT JOIN b USING (holdout_year, model_group)"""


def _baseline(t: DataFrame) -> DataFrame:
    t = t.select("holdout_year", "model_group", "train_rows", "holdout_rows", "train_positives", "train_negatives", "status", "train_prevalence", "baseline_brier")
    return t.withColumns({c: F.round(c, 8) for c in ("train_prevalence", "baseline_brier")})


@query("e04_rolling_logistic")
def rolling_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling folds: status, counts and all probability metrics, against the prevalence of the training part."""
    return B.evaluate_probabilities(base.modelling(spark, sf_dir), probabilities(spark, sf_dir, YEARS), YEARS, "observed")


@query("e04_baseline", _baseline_sql(YEARS))
def rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(rolling_logistic(spark, sf_dir))


@query("e04_own_predictors")
def own_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``e04_rolling_logistic`` with each group's own predictors, all groups, windows and penalties in the same steps."""
    rows = base.modelling(spark, sf_dir)
    return B.evaluate_probabilities(rows, B.rolling_logistic(rows, YEARS, OWN, "observed"), YEARS, "observed")


#: One predictor that is never missing, or none.
_RATED = {"BUILDING": ["rating"], "AUTOMOBILE": [], "MACHINERY": ["rating"], "HOUSEHOLD": []}


@query(
    "e04_m07_one_predictor",
    f"""WITH RECURSIVE {base.MODEL_SQL}, y(holdout_year) AS (VALUES (1998), (1999), (2000)), f AS (
      SELECT entry_key, holdout_year, model_group, season < holdout_year AS train, observed, CASE WHEN model_group IN ('BUILDING', 'MACHINERY') THEN CAST(rating AS DOUBLE) ELSE 0 END AS v
      FROM m JOIN y ON season <= holdout_year
    ), g AS (
      SELECT holdout_year, model_group, avg(v) FILTER (train) AS a, stddev_pop(v) FILTER (train) AS sd, avg(observed) FILTER (train) AS prevalence FROM f GROUP BY ALL
      HAVING count(*) FILTER (train) >= 40 AND count(*) FILTER (NOT train) >= 20 AND sum(observed) FILTER (train) >= 5 AND sum(1 - observed) FILTER (train) >= 5
    ), x AS (SELECT f.*, (v - a) / CASE WHEN sd < 1e-12 THEN 1 ELSE sd END AS z FROM f JOIN g USING (holdout_year, model_group)),
    b AS (
      SELECT 0 AS step, holdout_year, model_group, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM g
      UNION ALL
      SELECT step + 1, holdout_year, model_group, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT step, holdout_year, model_group, b0, b1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) + 10 AS h11, sum(observed - p) AS g0, sum(z * (observed - p)) - 10 * b1 AS g1
        FROM (SELECT step, holdout_year, model_group, b0, b1, z, observed, 1 / (1 + exp(-b0 - b1 * z)) AS p FROM b JOIN x USING (holdout_year, model_group) WHERE train AND step < 12) GROUP BY step, holdout_year, model_group, b0, b1
      )
    )
    SELECT entry_key, holdout_year, model_group, round(prevalence, 8) AS prevalence, round(1 / (1 + exp(-b0 - b1 * z)), 6) AS probability
    FROM x JOIN g USING (holdout_year, model_group) JOIN b USING (holdout_year, model_group) WHERE NOT train AND step = 12""",
)
def one_logistic_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic fit of one predictor or none for each group, next to twelve Newton steps in SQL."""
    t = B.rolling_logistic(base.modelling(spark, sf_dir), YEARS, _RATED, "observed", grid=(10.0,))
    return t.select("entry_key", "holdout_year", "model_group", F.round("prevalence", 8).alias("prevalence"), F.round("probability", 6).alias("probability"))


@query("a27_pooled")
def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All probability metrics over all folds together, for the model and the prevalence."""
    return B.pooled_probabilities(probabilities(spark, sf_dir, YEARS), "observed")


@query("e05_stress_test")
def stress_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold: trained on all earlier years, scored on the last; a row per group."""
    return B.evaluate_probabilities(base.modelling(spark, sf_dir), probabilities(spark, sf_dir, [2000]), [2000], "observed")


@query("e05_overall")
def stress_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All probability metrics of the stress test over all groups together, next to ``e05_stress_test``'s rows per group."""
    return B.pooled_probabilities(probabilities(spark, sf_dir, [2000]), "observed")


@query("e05_baseline", _baseline_sql([2000]))
def stress_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(stress_test(spark, sf_dir))


@query("e06_m06_final_fit")
def final_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = base.modelling(spark, sf_dir)
    return B.final_fit(m.where("season < 2000"), m.where("season = 2000"), YEARS[:2], COLUMNS, "target")


@query(
    "e06_m06_one_predictor",
    f"""WITH {base.MODEL_SQL}, x AS (
      SELECT m.*, season < 2000 AS train, CASE model_group {' '.join(f"WHEN '{g}' THEN {c}" for g, c in _ONE.items())} END AS p FROM m WHERE season <= 2000
    ), d AS (SELECT model_group, coalesce(median(p), 0) AS med, count(*) AS train_rows FROM x WHERE train GROUP BY 1),
    i AS (SELECT x.*, coalesce(p, med) AS v, CAST(p IS NULL AS DOUBLE) AS gone, train_rows FROM x JOIN d USING (model_group)),
    s AS (
      SELECT model_group, avg(v) AS a, CASE WHEN stddev_pop(v) < 1e-12 THEN 1 ELSE stddev_pop(v) END AS sd, avg(target) AS ty, avg(gone) AS ag FROM i WHERE train GROUP BY 1
    ), q AS (
      SELECT model_group, sum(power((v - a) / sd, 2)) + 10 AS zz, sum((v - a) / sd * (gone - ag)) AS zg, sum(power(gone - ag, 2)) + 10 AS gg,
        sum((v - a) / sd * (target - ty)) AS zy, sum((gone - ag) * (target - ty)) AS gy FROM i JOIN s USING (model_group) WHERE train GROUP BY 1
    )
    SELECT entry_key, season, model_group, train_rows, round(ty + (gg * zy - zg * gy) / (zz * gg - zg * zg) * (v - a) / sd + (zz * gy - zg * zy) / (zz * gg - zg * zg) * (gone - ag), 3) AS prediction
    FROM i JOIN s USING (model_group) JOIN q USING (model_group) WHERE NOT train""",
)
def final_fit_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final fit on one predictor of each group and its missing flag with one penalty, solved by hand in SQL."""
    m, own = base.modelling(spark, sf_dir), {g: [c] for g, c in _ONE.items()}
    t = B.final_fit(m.where("season < 2000"), m.where("season = 2000"), YEARS[:2], own, "target", grid=(10.0,))
    return t.select("entry_key", "season", "model_group", "train_rows", F.round("prediction", 3).alias("prediction"))
