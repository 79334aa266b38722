import random
import re

import pytest

from keelson.operators import bridge, features
from keelson.plans import entity_queries

LINKS = "entry_key string, player_id string, season int, origin string, destination string"
STATS = "player_id string, season int, team string, category string, stat_type string, stat string"


def test_linked_stats_equal_all_pairs(spark):
    """Teams that are written in several ways, blank or absent; several links of a player and season, equal rows."""
    rng = random.Random(5)
    team = lambda: rng.choice(["Ohio State", "ohio-state", "OHIO  STATE", "Téxas", "Texas", "", "-", None])
    player = lambda: rng.choice(["1", "2", "3", None])
    links = [(f"e{i // 2}", player(), rng.choice([2023, 2024, None]), team(), team()) for i in range(60)]
    stats = [(player(), rng.choice([2022, 2023, 2024, None]), team(), "passing", "YDS", str(i)) for i in range(80)]
    links, stats = [*links, *links[:4]], [*stats, *stats[:4]]
    plain = lambda x: " ".join((x or "").lower().replace("é", "e").replace("-", " ").split())
    want = [
        (e, p, c, k, v, season, t, phase)
        for e, lp, ls, origin, destination in links
        for phase, shift, of in (("pre", 1, origin), ("post", 0, destination))
        for p, season, t, c, k, v in stats
        if None not in (p, ls, season) and p == lp and season == ls - shift and plain(t) == plain(of)
    ]
    got = bridge.linked_stats(spark.createDataFrame(links, LINKS), spark.createDataFrame(stats, STATS))
    assert got.columns == ["entry_key", "player_id", "category", "stat_type", "stat", "season", "team", "phase"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 50


@pytest.mark.parametrize("query", ["linked", "has_features"])
def test_no_join_is_by_an_expression(spark, query):
    """A sort by a join's expression would compute it at every comparison."""
    t = getattr(entity_queries, query)(spark, "/root/testdata/sf0.001")
    plan = t._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [x for x in plan if "Join " in x]
    assert joins and not [x for x in joins if "regexp_replace" in x]


def exchanges(t):
    """Shuffles of a plan by their keys, as planned before any runs; a shuffle that is used again counts once."""
    spark, held = t.sparkSession, {}
    for k, v in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        held[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    try:
        plan = t.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"(?<!Reused)Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_null_keys_are_dropped_behind_what_makes_the_links(spark, tmp_path):
    rows = [("e1", "1", 2024, "a", "b"), ("e1", "1", 2024, "a", "b"), ("e2", None, 2024, "a", "b"), ("e3", "3", None, "a", "b")]
    spark.createDataFrame(rows, LINKS).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links").distinct()
    stats = spark.createDataFrame([("1", 2023, "A", "passing", "YDS", "7"), (None, 2023, "a", "passing", "YDS", "8"), ("3", None, "b", "passing", "YDS", "9")], STATS)
    linked = bridge.linked_stats(links, stats).select("entry_key", "stat", "phase")
    assert [tuple(r) for r in linked.collect()] == [("e1", "7", "pre")]
    # What makes the links isn't filtered for one of their readers, so its shuffle is one for all of them.
    plan = linked._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [plan[i + 1] for i, x in enumerate(plan) if "Aggregate [" in x]
    assert len(below) == 1 and "Relation [" in below[0], below


VALUES = "entry_key string, feature string, value double"


@pytest.mark.parametrize(
    "rows, clash",
    [
        ([("a", "x", 1.0), ("a", "y", 1.0), ("a", "y", 2.0)], "a y"),
        ([("a", "x", 1.0), ("a", "z", 1.0), ("a", "z", 2.0)], "a z"),
        ([("a", "x", 1.0), ("a", None, 1.0), ("a", None, 2.0)], "a"),
        ([(None, "x", 1.0), (None, "x", 2.0)], "x"),
        ([("a", "x", 1.0), ("a", "x", float("nan"))], "a x"),
    ],
)
def test_any_clash_is_an_error_when_a_column_is_read(spark, rows, clash):
    t = features.pivot(spark.createDataFrame(rows, VALUES), "entry_key", ["x", "y"])
    with pytest.raises(Exception, match=f"conflicting values for {clash}"):
        t.select("entry_key", "x").collect()
    assert t.select("entry_key").count() == 1


def test_pivot_of_odd_rows_in_a_row_for_each_key(spark):
    """Null keys, features and values, equal rows, features that aren't listed; a key's features meet in one row before the shuffle."""
    nan = float("nan")
    rows = [("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", None), ("b", "x", 0.0), ("b", "x", -0.0), ("c", "z", 5.0), ("c", "w", 6.0), ("d", None, None), (None, "y", 3.0), (None, "z", 4.0), ("e", "y", nan), ("e", "y", nan)]
    t = features.pivot(spark.createDataFrame(rows, VALUES), "entry_key", ["x", "y"])
    assert t.columns == ["entry_key", "x", "y"] and dict(t.dtypes)["x"] == "double"
    want = [("a", 1.0, 2.0), ("b", 0.0, None), ("c", None, None), ("d", None, None), ("e", None, nan), (None, None, 3.0)]
    got = [(r[0], r[1] if r[1] is None else abs(r[1]), r[2]) for r in t.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert features.pivot(spark.createDataFrame([], VALUES), "entry_key", ["x"]).count() == 0
    assert len(exchanges(t)) == 2 and not [x for x in exchanges(t) if "feature" in x]


def test_bridge_equals_all_pairs(spark):
    """Null players, seasons and teams, blanks around teams, several links of a player and season, equal rows."""
    rng = random.Random(7)
    team = lambda: rng.choice(["Rice", " rice ", "RICE", "Navy", "", None])
    player = lambda: rng.choice(["1", "2", "3", None])
    links = [(f"e{i // 2}", player(), rng.choice([2023, 2024, 2026, None]), team(), team()) for i in range(60)]
    stats = [(player(), rng.choice([2022, 2023, 2024, None]), team(), "passing", "YDS", str(i)) for i in range(24)]
    links, stats = [*links, *links[:4]], [*stats, *stats[:4]]
    plain = lambda x: (x or "").strip().lower()
    want = []
    for e, p, s, *of in links:
        row = [e, p, s]
        for shift, expected in ((1, of[0]), (0, of[1])):
            mine = [t for q, season, t, *_ in stats if None not in (p, s, season) and q == p and season == s - shift]
            there = sum(plain(t) == plain(expected) for t in mine)
            names = sorted({t.strip() for t in mine if (t or "").strip()})
            row += [s is not None and s - shift in {x[1] for x in stats}, len(mine), names, there, bool(mine) and not there]
        want.append((*row, not row[8]))
    t = bridge.season_bridge(spark.createDataFrame(links, LINKS), spark.createDataFrame(stats, STATS))
    sides = [f"{side}_{c}" for side in ("pre", "post") for c in ("source_available", "stat_row_count", "stat_teams", "expected_row_count", "team_mismatch")]
    got = t.select("entry_key", "player_id", "season", *sides, "post_outcome_right_censored").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    each = ["source_available", "expected_row_count", "has_stats", "has_expected_stats", "team_mismatch"]
    counted = ["pre_stat_row_count", "pre_stat_teams", "post_stat_row_count", "post_stat_teams"]
    flags = [f"{side}_{c}" for side in ("pre", "post") for c in each]
    assert t.columns == ["entry_key", "player_id", "season", "origin", "destination", "pre_season", *counted, *flags, "complete_pre_post", "post_outcome_right_censored"]


def joins(node):
    below = [x for i in range(node.children().size()) for x in joins(node.children().apply(i))]
    return [node, *below] if node.nodeName() == "Join" else below


def test_lists_of_a_side_end_with_its_join(spark, tmp_path):
    """The second join shuffles the links again: with counts of the first side, not with its teams."""
    spark.createDataFrame([("e1", "1", 2024, "a", "b"), ("e1", "1", 2024, "a", "b")], LINKS).write.parquet(f"{tmp_path}/links")
    links = spark.read.parquet(f"{tmp_path}/links").distinct()
    stats = spark.createDataFrame([("1", 2023, "A", "passing", "YDS", "7"), ("1", 2024, "B", "passing", "YDS", "8")], STATS)
    t = bridge.summary(bridge.season_bridge(links, stats))
    assert (t.first().n, t.first().complete_pre_post) == (1, 1)
    plan = t._jdf.queryExecution().optimizedPlan()
    second = [j.left().output().mkString(" ") for j in joins(plan) if "post_id" in j.condition().toString()]
    assert len(second) == 1 and "pre_has_expected_stats#" in second[0] and "_pre#" not in second[0], second
    # Both readers of the distinct links read the same rows, so their shuffle is one.
    lines = plan.toString().splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "Aggregate [" in x and "destination" in x]
    assert below and not [x for x in below if "Filter" in x], below
