"""Operators on small fixtures with values worked out by hand."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.functions import scalars as S
from keelson.operators import audit, backtest, bridge, cohorts, features, gates, metrics, models, present, resolve
from keelson.sources import archive, tables

ENTRY = "entry_key string, season int, first_name string, last_name string, position string, destination string"
ROSTER = "player_id string, season int, team string, first_name string, last_name string, position string, year int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [("Smith, Jr.", "smith jr"), ("  Ohio-State ", "ohio state"), ("Müller ß", "muller ss"), ("", ""), (None, ""), ("...", "")],
)
def test_normalize(spark, text, want):
    assert one(spark, S.normalize_token(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text, want", [("Smith Jr.", "smith"), ("Jones III", "jones"), ("Jr", ""), ("Junior", "junior"), ("Smith Sr Jr", "smith sr")])
def test_last_name(spark, text, want):
    assert one(spark, S.normalize_last_name(F.lit(text))) == want


@pytest.mark.parametrize("a, b, want", [("mike", "michael", True), ("bill", "billy", True), ("mike", "mason", False), ("", "", False), ("zed", "zed", True)])
def test_alias(spark, a, b, want):
    assert one(spark, S.first_name_alias(F.lit(a), F.lit(b))) is want


def test_all_of_unicode_folds_as_by_decomposition(spark):
    """Every code point between two letters: all that Unicode decomposes, marks and Hangul included."""
    import unicodedata

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(f"a{c}b",) for c in chars], "c string").select("c", S.fold(F.col("c")).alias("f")).toPandas()
    want = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in got["c"]]
    assert len(want) == len(chars) and got["f"].tolist() == want


@pytest.mark.parametrize("code, group, model", [("fb", "RB", "RB"), ("PK", "PK", "K"), ("K", "ST", "K"), ("LS", "ST", "LS"), ("", "", "OTHER"), ("Q B", "QB", "QB"), ("XX", "XX", "XX")])
def test_groups(spark, code, group, model):
    assert one(spark, S.position_group(F.lit(code))) == group
    assert one(spark, S.model_position_group(F.lit(code))) == model


@pytest.mark.parametrize("text, want", [("1,234", 1234.0), ("45%", 45.0), (" -.5 ", -0.5), ("1e3", 1000.0), (None, None)])
def test_strict_number(spark, text, want):
    assert one(spark, S.strict_number(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text", ["", "abc", "1.0d", "nan", "inf", "1e999"])
def test_strict_number_refuses(spark, text):
    with pytest.raises(Exception, match="not a finite number"):
        one(spark, S.strict_number(F.lit(text)))


def test_other_parsers(spark):
    assert one(spark, S.lenient_number(F.lit(" "))) is None and one(spark, S.lenient_number(F.lit("NaN"))) is None
    assert one(spark, S.lenient_number(F.lit("1,5"), commas=True)) == 15.0
    assert math.isnan(one(spark, S.plain_number(F.lit("NaN"))))
    assert [one(spark, S.binary_flag(F.lit(x))) for x in ("1", "True", "", "false")] == [1, 1, 0, 0]
    for bad in (S.binary_flag(F.lit("yes")), S.boolean(F.lit("maybe")), S.boolean(F.lit(None).cast("string")), S.lenient_number(F.lit("x"))):
        with pytest.raises(Exception, match="not a"):
            one(spark, bad)
    assert one(spark, S.feature_name(F.lit("pre"), F.lit("Passing"), F.lit("Yds/Att"))) == "pre_passing_yds_att"
    with pytest.raises(Exception, match="empty part"):
        one(spark, S.feature_name(F.lit("pre"), F.lit("--")))
    assert one(spark, S.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75 and one(spark, S.similarity(F.lit(""), F.lit("a"))) == 0.0
    assert one(spark, S.fold(F.lit("ﬁn é ½"))) == "fin e 1⁄2"
    assert one(spark, S.sigmoid(F.lit(-1000.0))) == 1e-9 and one(spark, S.sigmoid(F.lit(0.0))) == 0.5


@pytest.mark.parametrize(
    "text", ["Šarić", "Tānē", "cafe\u0301s", "Straße", "ﬁn ÉÑ", "Łódź Ångström", "ｆｕｌｌ Ｗｉｄｔｈ", "İstanbul", "Ǆ x", "漢字 é", "O'Neal-Šmith", "\u0301a", None, ""]
)
def test_names_fold_as_by_decomposition(spark, text):
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).casefold()
    want = " ".join(re.sub("[^a-z0-9]+", " ", plain).split())
    got = one(spark, S.normalize_token(F.lit(text).cast("string")))
    assert got == want


@pytest.mark.parametrize("code, group, model", [("D/T", "DL", "DL"), ("q-b", "QB", "QB"), (" p.k ", "PK", "K"), ("l/s", "ST", "LS"), ("--", "", "OTHER")])
def test_codes_are_normalised_first(spark, code, group, model):
    assert one(spark, S.position_group(F.lit(code))) == group
    assert one(spark, S.model_position_group(F.lit(code))) == model


def test_entry_key(spark):
    import hashlib

    row = {"season": 2024, "first_name": "Jórdan", "last_name": "Smith Jr.", "position": "wr", "origin": "Ohio-State", "transferDate": "2024-01-05T00:00", "rating": 0.95, "stars": 4}
    df = spark.createDataFrame([tuple(row.values())], list(row))
    want = {
        "season": 2024, "first_name": "jordan", "last_name": "smith", "position": "WR", "origin": "ohio state", "destination": "",
        "transfer_date": "2024 01 05t00 00", "rating": "0.95", "stars": "4", "eligibility": "",
    }
    assert df.select(S.entry_key(df.columns)).first()[0] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_observability_reasons_and_flags(spark):
    names = "season int, match_strategy string, post_stats_source_available boolean, post_outcome_right_censored boolean, model_group string, post_anchor double, post_has_player_stats boolean, has_features boolean"
    rows = [
        (2020, "next_season_fallback", True, False, "QB", 1.0, True, True), (2021, "next_season_fallback", True, False, "QB", 1.0, True, True),
        (2022, "same_season", None, False, "QB", 1.0, True, True), (2023, "same_season", True, False, "K", 1.0, True, True),
        (2024, "same_season", True, False, "QB", 1.0, True, False), (2025, "same_season", True, False, "QB", None, True, True), (2025, "same_season", True, False, "QB", 2.0, None, True),
    ]
    out = cohorts.observability(spark.createDataFrame(rows, names)).collect()
    assert [r.exclusion_reason for r in out] == ["outside_seasons", "not_same_season_roster_link", "post_stats_source_unavailable", "unsupported_position", "missing_feature_row", None, None]
    assert [(r.target_observed, r.any_stat_observed, r.any_stat_no_target, r.no_any_stat) for r in out[5:]] == [(0, 1, 1, 0), (1, 0, 0, 1)]
    assert not any(c.startswith("post_") for c in out[0].asDict())


def test_identity_key(spark):
    def key(**kw):
        return one(spark, S.identity_key({k: S.normalize_token(F.lit(v)) for k, v in kw.items()}))

    assert key(last="Smith Jr.", origin="Ohio State") == key(last="Smith, Jr", origin="Ohio-State")
    assert key(last="Smith", destination="Texas") != key(last="Smith", destination="USC")
    import hashlib

    assert key(b="x", a="Y z") == hashlib.sha256(json.dumps({"a": "y z", "b": "x"}, separators=(",", ":")).encode()).hexdigest()


def resolved(spark, entries, roster, fallback=False):
    e = spark.createDataFrame([(f"e{i}", 2024, *x) for i, x in enumerate(entries)], ENTRY)
    r = spark.createDataFrame(roster, ROSTER)
    out = (resolve.resolve_with_fallback if fallback else resolve.resolve)(e, r)
    return {x.entry_key: x for x in out.collect()}


@pytest.mark.parametrize(
    "entry, roster, status, reason, player",
    [
        (("Jordan", "Smith Jr.", "WR", "Texas"), [("101", "Jordan", "Smith", "WR"), ("102", "John", "Smith", "WR")], "resolved", "high_confidence", "101"),
        (("Mike", "Brown", "QB", "Texas"), [("7", "Michael", "Brown", "QB"), ("8", "Mason", "Brown", "QB")], "resolved", "high_confidence", "7"),
        (("Chris", "Jones", "DB", "Texas"), [("1", "Chris", "Jones", "CB"), ("2", "Christopher", "Jones", "S")], "ambiguous", "same_name_collision", None),
        (("Chris", "Jones", "DB", None), [("1", "Chris", "Jones", "CB")], "unresolved", "no_destination", None),
        (("Chris", "Jones", "DB", "Rice"), [("1", "Chris", "Jones", "CB")], "unresolved", "no_destination_roster_candidate", None),
        (("Sam", "Hill", "QB", "texas"), [("1", "Sam", "Hill", "QB"), ("2", "Sam", "Hill", "CB")], "resolved", "high_confidence", "1"),
        (("Zed", "Quux", "QB", "Texas"), [("1", "Al", "Hill", "QB")], "unresolved", "low_match_score", None),
    ],
)
def test_resolution(spark, entry, roster, status, reason, player):
    got = resolved(spark, [entry], [(i, 2024, "Texas", f, l, p, 3) for i, f, l, p in roster])["e0"]
    assert (got.status, got.reason, got.player_id) == (status, reason, player)


def test_margins_and_candidates(spark):
    got = resolved(spark, [("Jordan", "Smith", "WR", "Texas")], [("9", 2024, "Texas", "Jordan", "Smith", "WR", 1)])["e0"]
    assert got.score == 1.0 and got.second_score == 0.0 and got.score_margin == 1.0 and got.candidate_count == 1
    many = [(str(k), 2024, "Texas", "Jor" + "x" * k, "Smith", "WR", 1) for k in range(1, 9)]
    got = resolved(spark, [("Jordan", "Smith", "WR", "Texas")], many)["e0"]
    scores = [c.score for c in got.top_candidates]
    assert len(scores) == 5 and scores == sorted(scores, reverse=True) and got.candidate_count == 8


def test_names_of_a_team_are_compared_once(spark):
    """All candidates' ranks are those of the pairs, but no pair of entry and roster row is made for them."""
    rng = np.random.default_rng(5)
    first, last, pos = ["Mike", "Michael", "Ann", "Bo", ""], ["Lee", "Lee Jr.", "Day", "Moe"], ["QB", "WR", "CB", None]
    pick = lambda x: x[rng.integers(len(x))]
    e = [(f"e{i}", 2024, pick(first), pick(last), pick([*pos, "K"]), pick(["Texas", "texas", "Texas", "Rice", "Nowhere", None])) for i in range(300)]
    r = [(pick([str(i), str(i // 2), None]), 2024, pick(["Texas", "TEXAS", "Rice"]), pick(first), pick(last), pick(pos), 1) for i in range(300)]
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        asked.add(len(a))
        return pd.Series([float(x == y) / 2 for x, y in zip(a, b, strict=True)])

    e, r = spark.createDataFrame(e, ENTRY), spark.createDataFrame(r, ROSTER)
    pairs = resolve.block(e, r)
    n = pairs.count()
    want = {x.entry_key: x for x in resolve.rank(resolve.score(pairs, lambda a, b: (a == b).cast("double") / 2)).collect()}
    got = {x.entry_key: x for x in resolve.resolve(e, r, ratio).collect()}
    names = pairs.select("season", "e_team", "e_first", "e_last", "e_group", "r_first", "r_last", "r_group").distinct().count()
    assert n > 5 * names and 0 < asked.value <= 2 * names
    assert len(got) == 300 and {k for k, x in got.items() if x.candidate_count} == set(want)
    for k, x in want.items():
        assert (x.score, x.second_score, x.candidate_count, x.top_candidates) == (got[k].score, got[k].second_score, got[k].candidate_count, got[k].top_candidates)
    assert {x.entry_key: x for x in resolve.ranked(e, r, lambda a, b: (a == b).cast("double") / 2).collect()} == want
    # By hand: the pairs of an entry, their number and its exact ids.
    brute = {}
    for p in resolve.score(pairs, lambda a, b: (a == b).cast("double") / 2).collect():
        brute.setdefault(p.entry_key, []).append((-p.score, p.player_id or "", p.exact_name))
    for k, rows in brute.items():
        rows.sort()
        assert [(c.score, c.player_id) for c in want[k].top_candidates] == [(-s, i) for s, i, _ in rows[:5]]
        assert want[k].candidate_count == len(rows) and want[k].exact_ids == len({i for _, i, x in rows if x and i})


def test_fallback(spark):
    entries = [("Ann", "Lee", "QB", "Texas"), ("Chris", "Jones", "DB", "Texas"), ("Bo", "Day", "QB", "Rice")]
    roster = [
        ("1", 2024, "Texas", "Xu", "Moe", "QB", 1), ("2", 2025, "Texas", "Ann", "Lee", "QB", 1),
        ("3", 2024, "Texas", "Chris", "Jones", "CB", 1), ("4", 2024, "Texas", "Chris", "Jones", "S", 1), ("5", 2025, "Texas", "Chris", "Jones", "CB", 1),
    ]
    got = resolved(spark, entries, roster, fallback=True)
    a, b, c = got["e0"], got["e1"], got["e2"]
    assert (a.status, a.player_id, a.match_strategy, a.roster_match_season, a.same_season_reason) == ("resolved", "2", "next_season_fallback", 2025, "low_match_score")
    assert (b.status, b.match_strategy, b.fallback_status) == ("ambiguous", "none", "not_attempted")
    assert (c.status, c.fallback_status) == ("unresolved", "unresolved")
    got = resolved(spark, entries[:1], roster[:1], fallback=True)["e0"]
    assert (got.fallback_status, got.fallback_reason) == ("unavailable", "next_roster_not_archived")


def test_accounting(spark):
    t = spark.createDataFrame([("resolved", "a"), ("resolved", "a"), ("ambiguous", "b"), ("unresolved", "c")], "status string, reason string")
    got = audit.accounting(t).first()
    assert (got.n, got.resolved, got.held_out, got.resolved_rate) == (4, 2, 2, 0.5)
    assert audit.accounting(t.limit(0)).first().resolved_rate is None


def test_sample_is_independent_of_layout(spark):
    t = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "k int, s string")
    a = sorted(r.k for r in audit.stratified_sample(t, "k", ["s"], 3, 7).collect())
    assert len(a) == 9 and a == sorted(r.k for r in audit.stratified_sample(t.repartition(5), "k", ["s"], 3, 7).collect())


def test_weighted_precision(spark):
    labels = [(y, "correct") for y in range(2022, 2027)] + [(2021, "correct"), (2021, "incorrect"), (2022, "uncertain")]
    t = spark.createDataFrame(labels, "g int, label_outcome string")
    population = spark.createDataFrame([(y, 10) for y in range(2021, 2027)], "g int, population_n long")
    got = audit.weighted_precision(t, population, "g").first()
    assert math.isclose(got.strict_rate, (0.5 + 0.5 + 4) / 6) and math.isclose(got.possible_rate, (0.5 + 5) / 6)
    assert got.strict_low < got.strict_rate < got.strict_high <= 1
    bad = spark.createDataFrame([("correct", "1", "2"), ("uncertain", "1", "1"), ("maybe", "", "")], "label_outcome string, predicted_player_id string, expected_player_id string")
    assert tuple(audit.label_conflicts(bad).first()) == (1, 1, 1)


def test_bridge(spark):
    links = spark.createDataFrame([("a", "1", 2024, "Ohio State", "Texas"), ("b", "2", 2024, "Rice", "Texas"), ("c", "1", 2026, "Texas", "USC")], "entry_key string, player_id string, season int, origin string, destination string")
    stats = spark.createDataFrame([("1", 2023, "Ohio-State", "passing", "YDS", "10"), ("1", 2024, "Texas", "passing", "YDS", "12"), ("2", 2023, "Navy", "rushing", "YDS", "3")], "player_id string, season int, team string, category string, stat_type string, stat string")
    got = {r.entry_key: r for r in bridge.season_bridge(links, stats).collect()}
    assert got["a"].complete_pre_post and not got["a"].pre_team_mismatch and got["a"].pre_stat_teams == ["Ohio-State"]
    assert got["b"].pre_has_stats and not got["b"].pre_has_expected_stats and got["b"].pre_team_mismatch
    assert got["c"].post_outcome_right_censored and not got["a"].post_outcome_right_censored
    assert sorted((r.entry_key, r.phase) for r in bridge.linked_stats(links, stats).collect()) == [("a", "post"), ("a", "pre")]


def test_pivot_and_conflicts(spark):
    values = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 0.0)], "entry_key string, feature string, value double")
    got = {r.entry_key: r for r in features.pivot(values, "entry_key", ["x", "y", "z"]).collect()}
    assert (got["a"].x, got["a"].y, got["a"].z, got["b"].x, got["b"].y) == (1.0, 2.0, None, None, 0.0)
    clash = values.unionByName(spark.createDataFrame([("a", "x", 501.0)], values.schema))
    assert features.conflicts(clash, ["entry_key", "feature"]).count() == 1
    with pytest.raises(Exception, match="conflicting values"):
        features.pivot(clash, "entry_key", ["x"]).collect()


def test_cohorts(spark):
    rows = [("a", "QB", 1200.0, 1800.0, False), ("b", "OT", 1.0, 2.0, False), ("c", "QB", None, 5.0, False), ("d", "QB", 1.0, None, False), ("e", "QB", 1.0, 2.0, True)]
    t = spark.createDataFrame(rows, "entry_key string, position string, pre_passing_yds double, post_passing_yds double, post_outcome_right_censored boolean")
    t = cohorts.with_targets(t, "position")
    v1 = {r.entry_key: r for r in cohorts.modelling_both_anchors(t).collect()}
    assert v1["a"].target_delta == 600 and v1["a"].exclusion_reason is None and v1["b"].model_group == "OL"
    assert [v1[k].exclusion_reason for k in "bcd"] == ["unsupported_position_target", "missing_pre_anchor", "missing_post_anchor"]
    v2 = {r.entry_key: r for r in cohorts.modelling_outcome_observed(t).collect()}
    assert [v2[k].exclusion_reason for k in "acde"] == [None, None, "missing_post_target", "post_outcome_right_censored"]
    assert v2["c"].baseline_missing and v2["c"].target_delta is None
    assert cohorts.kept(cohorts.modelling_outcome_observed(t)).count() == 2
    with pytest.raises(ValueError, match="after the event"):
        cohorts.assert_no_leak(t)


@pytest.mark.parametrize("gone, n, want", [("false", "2", "STRONG"), ("false", "3", "STANDARD"), ("true", "0", "LIMITED")])
def test_support(spark, gone, n, want):
    assert one(spark, cohorts.support(F.lit(gone), F.lit(n))[0]) == want


@pytest.mark.parametrize("gone, n", [("maybe", "1"), ("false", "-1"), ("false", None)])
def test_support_refuses(spark, gone, n):
    with pytest.raises(Exception, match="not a boolean|count is"):
        one(spark, cohorts.support(F.lit(gone), F.lit(n).cast("string"))[0])


def test_metrics(spark):
    t = spark.createDataFrame([("g", 10.0, 12.0), ("g", 20.0, 16.0), ("h", 1.0, 1.0)], "g string, y double, p double")
    got = {r.g: r for r in metrics.regression(t, ["g"], "y", "p").collect()}
    assert got["g"].mae == 3 and math.isclose(got["g"].rmse, math.sqrt(10)) and got["h"].r2 is None
    s = spark.createDataFrame([(1, 0.9, 1), (0, 0.4, 2), (1, 0.4, 3), (0, 0.1, 4)], "y int, p double, k int")
    assert metrics.roc_auc(s, [], "y", "p").first().roc_auc == 0.875
    assert math.isclose(metrics.average_precision(s, [], "y", "p", "k").first().average_precision, (1 + 2 / 3) / 2)
    flat = spark.createDataFrame([(1, 0.5, 1), (0, 0.5, 2)], "y int, p double, k int")
    assert metrics.average_precision(flat, [], "y", "p", "k").first().average_precision == 0.5
    bins = metrics.reliability(spark.createDataFrame([(1, 1.0), (0, 0.05)], "y int, p double"), "y", "p").orderBy("bin").collect()
    assert [b.n for b in bins] == [1] + [0] * 8 + [1]
    grid = spark.createDataFrame([("g", 1.0, 5.0), ("g", 10.0, 5.0), ("g", 100.0, None)], "g string, a double, s double")
    assert metrics.best_of_grid(grid, ["g"], "a", "s").first().a == 1.0
    assert one(spark, metrics.skill(F.lit(1.0), F.lit(0.0))) is None


def test_preprocess_uses_training_rows_only(spark):
    t = spark.createDataFrame([("g", None), ("g", 10.0), ("g", 20.0)], "g string, x double")
    got = metrics.preprocess(t, t.where("x is null or x = 10"), ["g"], ["x"]).orderBy(F.col("x").asc_nulls_first()).collect()
    assert [r.miss_x for r in got] == [1, 0, 0] and [r.z_x for r in got] == [0.0, 0.0, 10.0]
    m = spark.createDataFrame([("g", float(i)) for i in range(20)], "g string, x double")
    assert m.groupBy("g").agg(F.median("x").alias("m")).first().m == 9.5


def test_encoding_falls_back_to_the_mean(spark):
    train = spark.createDataFrame([("A", 10.0), ("B", 30.0)], "k string, y double")
    got = metrics.target_encoding(spark.createDataFrame([("A",), ("new",)], "k string"), train, "k", "y")
    assert {r.k: r.signal for r in got.collect()} == {"A": 10.0, "new": 20.0}


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=60)
    t = spark.createDataFrame([("g", [1.0, *map(float, a)], float(b)) for a, b in zip(x, y, strict=True)], "g string, x array<double>, y double")
    beta = models.fit_ridge(t, ["g"], "x", "y", 10.0).first().beta
    m = np.column_stack([np.ones(60), x])
    want = np.linalg.solve(m.T @ m + np.diag([0, 10, 10]), m.T @ y)
    assert np.allclose(beta, want)
    with pytest.raises(np.linalg.LinAlgError):
        models.ridge_solve(np.zeros((2, 2)), np.zeros(2), 0.0)


def test_logistic(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.normal(size=300)])
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 1])))).astype(float)
    b = models.logistic_newton(x, y, 1.0)
    p = 1 / (1 + np.exp(-x @ b))
    assert np.allclose(x.T @ (y - p) - [0, b[1]], 0, atol=1e-5)
    with pytest.raises(ValueError, match="both classes"):
        models.logistic_newton(x, np.ones(300), 1.0)
    a, s = models.calibration_fit(x @ b, y)
    assert s > 0.9 and models.calibration_fit(np.zeros(5), y[:5]) == (None, None)


def test_logistic_fits_are_sums(spark, monkeypatch):
    """All groups' fits equal those on whole arrays, and no group's rows meet in a Python frame."""
    rng = np.random.default_rng(3)
    rows = [(g, [1.0, float(a), float(a * a)], int(rng.random() < 1 / (1 + np.exp(-a))) if g != "one" else 1, l) for g, l, n in (("a", 1.0, 400), ("b", 10.0, 90), ("one", 1.0, 5)) for a in rng.normal(size=n)]
    t = spark.createDataFrame(rows, "g string, x array<double>, y int, l2 double")
    score = [(g, y, float(1 / (1 + np.exp(-x[1])))) for g, x, y, _ in rows] + [("flat", 0, 0.5), ("flat", 1, 0.5), ("apart", 0, 0.2), ("apart", 1, 0.8)]
    s = spark.createDataFrame(score, "g string, y int, p double")

    def met(self, *args, **kw):
        raise AssertionError("a group in one frame")

    monkeypatch.setattr(type(t.groupBy("g")), "applyInPandas", met)
    got = {r.g: r for r in models.fit_logistic(t, ["g"], "x", "y", "l2").collect()}
    assert set(got) == {"a", "b"}
    for g, r in got.items():
        mine = [(x, y, l) for k, x, y, l in rows if k == g]
        want = models.logistic_newton(np.array([x for x, _, _ in mine]), np.array([y for _, y, _ in mine], dtype=float), mine[0][2])
        assert r.train_rows == len(mine) and np.allclose(r.beta, want, atol=1e-9)
    fit = {r.g: r for r in models.calibration(s, ["g"], "y", "p").collect()}
    assert set(fit) == {"a", "b", "one", "flat", "apart"} and fit["flat"].n == 2 and fit["flat"].slope is None and fit["one"].intercept is None
    for g in ("a", "b"):
        q = np.array([p for k, _, p in score if k == g])
        want = models.calibration_fit(np.log(q / (1 - q)), np.array([y for k, y, _ in score if k == g], dtype=float))
        assert np.allclose((fit[g].intercept, fit[g].slope), want, atol=1e-9)


def fold_rows(spark, n, seasons, group="RB"):
    rng = np.random.default_rng(2)
    rows = []
    for s in seasons:
        for i in range(n if isinstance(n, int) else n[s]):
            a = float(rng.normal(300, 50))
            rows.append((f"{s}-{i}", s, group, a + float(rng.normal(0, 5)), a if i % 2 else None, a, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "entry_key string, season int, model_group string, target double, prior double, x double, label int")


def test_rolling_folds(spark):
    rows = fold_rows(spark, {2021: 45, 2022: 25, 2023: 10}, [2021, 2022, 2023])
    status = {r.holdout_year: r.status for r in backtest.fold_status(backtest.folds(rows, [2022, 2023]), backtest.ROLLING).collect()}
    assert status == {2022: "evaluated", 2023: "skipped_low_sample"}
    p = backtest.rolling_ridge(rows, [2022, 2023], ["x"], "target", "prior")
    got = backtest.evaluate(p, "target").collect()
    assert len(got) == 1 and got[0].n == 25 and got[0].paired_n == 12 and got[0].skill_vs_mean > 0.5
    assert p.select("alpha").distinct().first().alpha == 10.0


def test_labels_of_the_scored_year_change_nothing_before_it(spark):
    rows = fold_rows(spark, 60, [2021, 2022, 2023, 2024, 2025], "WR")
    flip = rows.withColumn("label", F.when(F.col("season") == 2025, 1 - F.col("label")).otherwise(F.col("label")))
    a, b = (backtest.rolling_logistic(t, [2025], ["x"], "label").orderBy("entry_key").collect() for t in (rows, flip))
    assert len(a) == 60 and {r.holdout_year for r in a} == {2025}
    assert [(r.prevalence, r.l2, r.probability) for r in a] == [(r.prevalence, r.l2, r.probability) for r in b]


def test_log_is_numbered_in_ranges(spark, monkeypatch):
    """Ids follow the order without gaps, and no task sorts the whole log."""
    written, write = [], archive.materialize
    monkeypatch.setattr(archive, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    t = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 97).alias("ts")).repartition(7)
    out = archive.with_ids(t, ["ts", "k"], 10)
    got = sorted((r.id, r.ts, r.k) for r in out.collect())
    want = sorted((k * 7919 % 97, k) for k in range(5000))
    assert got == [(10 + i, *x) for i, x in enumerate(want)] and out.columns == ["k", "ts", "id"]
    sizes = [r.n for r in written[0].groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 2500
    assert archive.with_ids(t.limit(0), ["ts", "k"]).collect() == []


def test_gates(spark):
    t = spark.createDataFrame([("a", "pre", 1), ("b", "post", None)], "k string, phase string, n int")
    gates.enforce(t, "k", 2, {"phase": F.col("phase").isin("pre", "post")})
    for kw in ({"rows": 3}, {"conditions": {"n": F.col("n") == 1}}):
        with pytest.raises(gates.GateError):
            gates.enforce(t, "k", **kw)
    with pytest.raises(gates.GateError):
        gates.enforce(t.union(t), "k")
    with pytest.raises(gates.GateError):
        gates.require_columns(t, ["k", "zz"])
    with pytest.raises(gates.GateError):
        gates.forbid_columns(t, ("ph",))
    with pytest.raises(gates.GateError):
        gates.require_column_counts(t, {"p": 2})
    assert gates.same_keys(t, t, "k") and not gates.same_keys(t, t.limit(1), "k")
    s = spark.read.json(spark.sparkContext.parallelize(['{"scoring": {"2026_used": false}}']))
    assert gates.nested_values(s, {"u": "scoring.2026_used"}, {"u": lambda x: x is False}) == {"u": False}


def test_archive(spark, tmp_path):
    t = spark.createDataFrame([("[1]",), ("[1]",), ("{}",)], "body string")
    root = str(tmp_path / "store")
    archive.store(t, "body", root)
    archive.store(t, "body", root)
    assert spark.read.parquet(root).count() == 2
    assert {r.n_downloads for r in archive.objects(t, "body").collect()} == {1, 2}
    log = spark.createDataFrame([(1, "roster", 2024, '{"year":2024}', "a"), (2, "roster", 2024, '{"team":"X","year":2024}', "b"), (3, "portal", 2024, "{}", "c")], "id long, endpoint string, season int, params_json string, object_path string")
    assert archive.latest_object(log, "roster").first().object_path == "b"
    assert archive.latest_object(log, "roster", 2024, {"year": 2024}).first().object_path == "a"
    got = archive.ingest_seasons(spark, "portal", lambda e, p: json.dumps([p]).encode(), 2023, 2024, {"team": None})
    assert [r.params_json for r in got.orderBy("season").collect()] == ['{"year":2023}', '{"year":2024}']
    for bad in (lambda: archive.ingest(spark, "nope", lambda e, p: b"[]"), lambda: archive.ingest(spark, "portal", lambda e, p: b"3"), lambda: archive.ingest_seasons(spark, "portal", lambda e, p: b"[]", 2, 1)):
        with pytest.raises(ValueError):
            bad()
    h = spark.createDataFrame([({"ETag": "x"},)], "h map<string,string>")
    assert h.select(archive.header(F.col("h"), "etag").alias("e")).first().e == "x"


def test_tables_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(2, None), (1, "é,\"x\"")], "b int, a string")
    tables.write_jsonl(t, str(tmp_path / "j"))
    assert sorted(tables.read_jsonl(spark, str(tmp_path / "j"), "a string, b int").collect(), key=str) == sorted(t.select("a", "b").collect(), key=str)
    tables.write_csv(t, str(tmp_path / "c"), ["b", "a"])
    assert tables.read_csv(spark, str(tmp_path / "c"), ["a"]).count() == 2
    with pytest.raises(ValueError):
        tables.write_csv(t, str(tmp_path / "d"), ["a"])
    (tmp_path / "arr.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert tables.read_json_array(spark, str(tmp_path / "arr.json")).count() == 2
    assert {r.sha256 for r in archive.file_hashes(spark, str(tmp_path / "arr.json")).collect()}
    tables.publish(spark, {"t": t}, "gold")
    assert spark.table("gold.t").count() == 2


def test_stream_stores_each_payload_once(spark, tmp_path):
    from keelson.streaming import ingest

    schema = "body string, ts timestamp"
    for k in range(2):
        spark.createDataFrame([("[1]",), (f"[{k}]",)], "body string").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
    s = ingest.first_seen(ingest.payload_stream(spark, str(tmp_path / "in"), schema), "body", "ts")
    q = s.writeStream.format("memory").queryName("payloads").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("payloads").count() == 2


def test_presentation(spark):
    t = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 3.0), ("a", "x", 1.0), ("b", None, 2.0)], "g string, k string, v double")
    assert sorted(r.group_rank for r in present.ranked(t.where("g = 'a'"), "g", "v").collect()) == [1, 1, 3]
    assert {r.g: (r.x, r.y, r.total) for r in present.cross_table(t, "g", "k", ["x", "y"]).collect()} == {"a": (2, 1, 3), "b": (0, 0, 0)}
    assert [r.v for r in present.top(t, "v", 2).collect()] == [3.0, 3.0]
    assert present.filtered(t, {"g": ["a"]}, "Y", ("k",)).count() == 1
    assert [r.g for r in present.in_order(t.select("g").distinct(), "g", ["b"]).collect()] == ["b", "a"]


def test_running_sums_cross_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(rng.integers(0, 5)), i, int(rng.integers(0, 3))) for g, n in (("a", 200), (None, 30), ("b", 1)) for i in range(n)]
    t = metrics.running_sums(spark.createDataFrame(rows, "g string, v int, i int, c int"), ["g"], [F.col("v").desc(), F.col("i")], ["c"])
    got = {(r.g, r.i): r["_sum_c"] for r in t.collect()}
    assert len(got) == len(rows)
    for g in ("a", None, "b"):
        total = 0
        for _, v, i, c in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])):
            total += c
            assert got[(g, i)] == total


def test_bundle(spark):
    """All metrics against whole arrays; groups of one class have no ranks and no calibration; none by name is one group."""
    rng = np.random.default_rng(6)
    rows = [(g, i, int(rng.random() < 0.4) if g else 1, float(np.round(rng.random(), 2))) for g, n in ((None, 4), ("x", 120), ("y", 60)) for i in range(n)]
    rows = [(g, f"{g}{i}", y, p) for g, i, y, p in rows]
    t = spark.createDataFrame(rows, "g string, k string, y int, p double")
    got = {r.g: r for r in metrics.bundle(t, ["g"], "y", "p", "k").collect()}
    assert set(got) == {None, "x", "y"} and got[None].roc_auc is None and got[None].slope is None and got[None].average_precision == 1.0
    whole = metrics.bundle(t, [], "y", "p", "k").collect()
    assert len(whole) == 1 and whole[0].n == len(rows)
    for r, mine in ((got["x"], [x for x in rows if x[0] == "x"]), (got["y"], [x for x in rows if x[0] == "y"]), (whole[0], rows)):
        y, p = np.array([x[2] for x in mine]), np.clip([x[3] for x in mine], 1e-9, 1 - 1e-9)
        wins = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
        order = sorted(range(len(mine)), key=lambda i: (-p[i], mine[i][1]))
        hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        assert np.isclose(r.roc_auc, wins) and np.isclose(r.average_precision, hits[y[order] == 1].mean()) and np.isclose(r.brier, ((p - y) ** 2).mean())
        assert np.allclose((r.intercept, r.slope), models.calibration_fit(np.log(p / (1 - p)), y.astype(float)), atol=1e-6)
    assert metrics.bundle(t.where("false"), [], "y", "p", "k").count() == 0


def test_negative_control_encodes_in_every_fold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for season, n in ((2022, 30), (2023, 30), (2024, 30), (2025, 15)):
        for i in range(n):
            d = int(rng.integers(0, 4))
            rows.append((f"{season}-{i}", season, "WR", " Town%d " % d if i % 2 else "TOWN%d" % d, float(rng.normal(80, 5)), float(rng.normal(50 * d, 10))))
    rows += [("few-1", 2024, "QB", "x", 1.0, 1.0), ("few-2", 2025, "QB", None, 1.0, 1.0)]
    rows.append(("new", 2025, "WR", "Elsewhere", 80.0, 75.0))
    t = spark.createDataFrame(rows, "entry_key string, season int, model_group string, destination string, rating double, prior_change double")
    predictions, result = backtest.negative_control(t, 2025, ["rating"], "destination")

    def fit(train, held, alpha):
        of = {}
        for r in train:
            of.setdefault(r[3].strip().lower(), []).append(r[5])
        mean = float(np.mean([r[5] for r in train]))
        x = [np.array([[np.mean(of.get(r[3].strip().lower(), [mean])), r[4]] for r in part]) for part in (train, held)]
        x = [np.column_stack([np.ones(len(v)), (v - x[0].mean(0)) / x[0].std(0)]) for v in x]
        beta = models.ridge_solve(x[0].T @ x[0], x[0].T @ np.array([r[5] for r in train]), alpha)
        return x[1] @ beta, mean

    mine = [r for r in rows if r[2] == "WR"]
    errors = {}
    for a in (0.1, 1.0, 10.0, 100.0, 1000.0):
        for year in (2023, 2024):
            held = [r for r in mine if r[1] == year]
            errors.setdefault(a, []).extend(np.abs(fit([r for r in mine if r[1] < year], held, a)[0] - [r[5] for r in held]))
    best = min(errors, key=lambda a: (np.mean(errors[a]), a))
    held = [r for r in mine if r[1] == 2025]
    want, mean = fit([r for r in mine if r[1] < 2025], held, best)
    got = {r.entry_key: r for r in predictions.collect()}
    assert set(got) == {r[0] for r in held} and {r.alpha for r in got.values()} == {best}
    assert np.allclose([got[r[0]].prediction for r in held], want) and np.isclose(got["new"].historical_mean, mean)
    by = {r.model_group: r for r in result.collect()}
    assert by["QB"].status == "skipped_low_sample" and by["QB"].mae is None and by["QB"].signal_detected is None
    assert by["WR"].signal_detected and np.isclose(by["WR"].mae, np.abs(want - [r[5] for r in held]).mean())


def test_skipped_for_one_class(spark):
    rows = fold_rows(spark, 30, [2021, 2022, 2023]).withColumn("label", F.lit(1))
    status = {r.holdout_year: r.status for r in backtest.fold_status(backtest.folds(rows, [2022, 2023]), backtest.OBSERVABILITY, "label").collect()}
    assert status == {2022: "skipped_low_sample", 2023: "skipped_low_train_class_count"}
