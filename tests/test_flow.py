"""Every step on a small archive: landed files to presented forecasts, and the commands."""

import json
import random
import threading

import pytest

from keelson import cli, flow
from keelson.operators import backtest
from keelson.operators.gates import GateError
from keelson.sources import publish, scratch
from keelson.streaming import log

SMALL = backtest.Gates(12, 4, 6, 3, 2, 1)
KINDS = {"QB": ("passing", "YDS", "ATT"), "WR": ("receiving", "YDS", "REC")}
PREDICTORS = {"QB": ["baseline_pre_production", "pre_passing_att", "rating"], "WR": ["baseline_pre_production", "rating", "stars"]}


def archive_files(root):
    """Nobody of 2024 has an outcome, each tenth player leaves no trace after the move, one entry has no destination."""
    rng, portal, roster, stats, n = random.Random(4), [], [], [], 0
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)).title()
    for season in range(2021, 2025):
        for group, (category, a, b) in KINDS.items():
            for i in range(10):
                n, first, last, to = n + 1, word(), word(), f"Team {i % 5}"
                portal.append({"season": season, "firstName": first, "lastName": last, "position": group, "origin": "Old State", "destination": to, "transferDate": "2021-01-01", "rating": 0.8 + i / 100, "stars": i % 3 + 2, "eligibility": None})
                roster.append({"id": n, "year": season, "team": to, "firstName": first, "lastName": last, "position": group})
                level = rng.gauss(500, 120)
                for year in range(season - 2, min(season, 2023) + 1):
                    if year == season and n % 10 == 0:
                        continue
                    for kind, v in ((a, level + rng.gauss(0, 30)), (b, level / 8)):
                        stats.append({"playerId": n, "season": year, "team": to if year == season else "Old State", "category": category, "statType": kind, "stat": f"{v:.1f}"})
    portal.append({"season": 2021, "firstName": "No", "lastName": "Where", "position": "QB", "origin": "Old State", "destination": None, "transferDate": None, "rating": None, "stars": None, "eligibility": None})
    out = []
    for name, rows in (("portal", portal), ("roster", roster), ("stats", stats)):
        out += [f"--{name}", str(root / f"{name}.json")]
        (root / f"{name}.json").write_text(json.dumps(rows))
    return out


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    files = archive_files(tmp_path_factory.mktemp("archive"))
    assert cli.main(["land", *files, "--schema", "season_flow"], spark) == 0
    return files


def test_all_steps(spark, landed, capsys):
    t = lambda name: spark.table(f"season_flow.{name}")
    common = ["--schema", "season_flow", "--years", "2023", "--season", "2024", "--first", "2021"]
    assert cli.main(["run", "resolutions", "bridges", *common, "--audit-rows", "3"], spark) == 0
    counts = json.loads(capsys.readouterr().out.splitlines()[-1])["rows"]
    assert counts["resolutions"] == 81 and counts["season_bridge"] == 80
    overall = t("resolver_accounting").where("season is null").first()
    assert (overall.n, overall.resolved) == (81, 80) and t("resolver_accounting").count() == 5
    assert t("label_sheet").count() == 4 and t("bridge_summary").where("season = 2024").first().post_outcome_right_censored == 20

    s = flow.Settings((2022, 2023), 2024, 2021, PREDICTORS, rolling=SMALL, holdout=SMALL, control=SMALL, observability=SMALL)
    counts = flow.run(spark, "season_flow", s, [x for x in flow.STEPS if x not in ("resolutions", "bridges")])
    assert counts["feature_matrix"] == 80 and counts["predictions"] == 20 and counts["forecasts"] == 20 and counts["scoring_excluded"] == 0
    matrix = t("feature_matrix").first().asDict()
    assert matrix["has_features"] and "pre_punting_ypp" in matrix
    # Six players (n % 10 = 0 of 2021 to 2023) have no outcome, all of 2024 are censored.
    assert t("modelling_v2").count() == 54 and t("modelling_excluded").count() == 26
    assert {r.exclusion_reason for r in t("modelling_excluded").collect()} == {"post_outcome_right_censored", "missing_post_target"}
    got = {(r.holdout_year, r.model_group): r for r in t("rolling").collect()}
    assert got[2023, "QB"].status == "evaluated" and got[2023, "QB"].skill_vs_mean > 0.3
    assert t("holdout").count() == 2 and t("control").where("status = 'evaluated'").count() == 2
    assert t("observability").count() == 4 and t("stress_test").count() == 2 and t("stress_test_overall").count() == 2
    assert t("stress_test_overall").where("forecast = 'model'").first().n == 20
    cohort = t("observability_cohort").where("exclusion_reason is null").collect()
    assert sum(r.n for r in cohort) == 60 and sum(r.observed for r in cohort) == 54
    forecasts = t("forecasts")
    assert not [c for c in forecasts.columns if c.startswith("post_")] and {r.group_rank for r in forecasts.where("model_group = 'QB'").collect()} == set(range(1, 11))
    assert t("forecast_support").agg({"total": "sum"}).first()[0] == 20


def test_a_step_refuses_a_table_that_changed(spark, landed):
    publish.publish_checked(spark.range(5).toDF("entry_key"), "season_lock.modelling_v2", "entry_key")
    spark.range(5).toDF("entry_key").write.mode("append").insertInto("season_lock.modelling_v2")
    with pytest.raises(GateError, match="fingerprint"):
        publish.require_published(spark, "season_lock.modelling_v2")
    with pytest.raises(ValueError, match="unknown steps"):
        flow.run(spark, "season_lock", flow.Settings((2023,), 2024, 2021), ["nothing"])


def test_resolve_ingest_and_precision(spark, landed, tmp_path, capsys):
    cli.main(["resolve", *landed[:4], "--output", str(tmp_path / "out.jsonl")], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["status_counts"] == {"resolved": 80, "unresolved": 1}
    for end in ("2023", "2022"):
        cli.main(["ingest", "roster", "--start", "2021", "--end", end, "--team", "x", "--root", str(tmp_path / "raw"), "--transport", "tests.test_flow:fetch"], spark)
    assert spark.read.parquet(str(tmp_path / "raw" / "objects")).count() == 3
    rows = log.read_log(spark, str(tmp_path / "raw" / "log")).orderBy("id").collect()
    assert [(r.id, r.season, r.batch) for r in rows] == [(1, 2021, 1), (2, 2022, 1), (3, 2023, 1), (4, 2021, 2), (5, 2022, 2)]
    assert json.loads(rows[0].params_json) == {"team": "x", "year": 2021} and rows[0].sha256 == rows[3].sha256
    with pytest.raises(SystemExit):
        cli.main(["ingest", "roster", "--start", "2023", "--end", "2021", "--root", "x", "--transport", "x"], spark)
    spark.sql("CREATE SCHEMA IF NOT EXISTS season_labels")
    rows = [(f"k{i}", "resolved", "same_season" if i < 8 else "next_season_fallback") for i in range(10)]
    spark.createDataFrame(rows, "entry_key string, status string, match_strategy string").write.mode("overwrite").saveAsTable("season_labels.resolutions")
    (tmp_path / "labels.csv").write_text("portal_key,label_outcome\nk0,correct\nk1,incorrect\nk8,correct\n")
    cli.main(["precision", str(tmp_path / "labels.csv"), "--schema", "season_labels"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["strict_rate"] == pytest.approx((8 * 0.5 + 2) / 10)


def fetch(endpoint, params):
    return json.dumps([{"endpoint": endpoint, **params}]).encode()


def test_workspaces_of_threads_are_their_own(spark):
    kept = []
    with scratch.workspace(spark):
        mine = scratch.materialize(spark.range(3), "mine")
        other = threading.Thread(target=lambda: kept.append(scratch.materialize(spark.range(4), "theirs")))
        other.start()
        other.join()
        assert mine.count() == 3
    assert kept[0].count() == 4
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|FILE_NOT_EXIST"):
        mine.collect()
