"""Operators against brute force on small inputs, and the properties they must keep."""

import math
import random
from datetime import date, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boutline.fixtures import SHARED_SITE
from boutline.functions import elo
from boutline.operators import features, ratings
from boutline.operators.asof import asof_backward
from boutline.operators.features import MODEL_FEATURES, build_features
from boutline.operators.retention import thin
from boutline.operators.running import cut_by_range, row_numbers, running
from boutline.operators.states import game_states
from boutline.operators.upsert import upsert

GAME = (
    "game_id string, season int, season_type string, game_date date, home_team_id long, away_team_id long, "
    "status string, home_score int, away_score int, is_neutral boolean"
)


def small_league(spark, seed=1, days=60, teams=6, pools=1):
    rng, rows = random.Random(seed), []
    day = date(2009, 12, 1)
    for i in range(days):
        day += timedelta(days=rng.choice([1, 1, 2, 30]))
        season = day.year - (day.month < 8)
        for pool in range(pools):
            order = rng.sample(range(pool * teams, pool * teams + teams), teams)
            for h, a in zip(order[: teams // 2], order[teams // 2 :]):
                if rng.random() < 0.3:
                    continue
                hs, as_ = rng.randint(80, 120), rng.randint(80, 120)
                status = "final" if i < days - 5 and rng.random() < 0.95 else "scheduled"
                score = (hs, as_) if status == "final" else (None, None)
                rows.append((f"{len(rows):06d}", season, "regular", day, h, a, status, *score, rng.random() < 0.1))
    return rows, spark.createDataFrame(rows, GAME)


def brute_elo(rows):
    rating, last, out = {}, {}, {}
    for gid, season, _, _, h, a, status, hs, as_, neutral in sorted(rows, key=lambda r: (r[3], r[0])):
        pre = []
        for t in (h, a):
            r = rating.get(t, 1500.0)
            pre.append(0.75 * r + 0.25 * 1505 if t in last and last[t] != season else r)
        if status == "final":
            d = pre[0] - pre[1] + (0 if neutral else 100)
            m = hs - as_
            mult = (abs(m) + 3) ** 0.8 / (7.5 + 0.006 * (d if m > 0 else -d))
            s = 20 * mult * ((m > 0) - 1 / (1 + 10 ** (-d / 400)))
            rating[h], rating[a] = pre[0] + s, pre[1] - s
            last[h] = last[a] = season
            out[gid] = (*pre, pre[0] + s, pre[1] - s)
        else:
            out[gid] = (*pre, None, None)
    return out


def assert_rated(df, expected):
    got = {r["game_id"]: tuple(r)[1:] for r in df.select("game_id", "home_elo_pre", "away_elo_pre", "home_elo_post", "away_elo_post").collect()}
    assert set(got) == set(expected)
    for gid, values in expected.items():
        for a, b in zip(got[gid], values):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9), gid


def one_pool(games):
    return games.withColumn("pool", F.lit("all"))


def test_rating_forms_agree_with_brute_force(spark):
    rows, games = small_league(spark, days=12, pools=2)
    expected = brute_elo(rows)
    pooled = games.withColumn("pool", (F.col("home_team_id") >= 6).cast("string"))
    assert_rated(ratings.stream_pools(pooled), expected)
    assert_rated(ratings.rate_games(one_pool(games)), expected)
    assert_rated(ratings.rate_in_rounds(pooled, name="t-rounds", checkpoint_every=4), expected)


def test_rating_forms_agree_on_double_dates_and_missing_scores(spark):
    """A team that plays twice on a date, and a final game without a score: the same rows."""
    d = [date(2009, 12, day) for day in (1, 1, 1, 2, 3, 3)]
    pairs = [(0, 1), (0, 2), (1, 2), (0, 1), (2, 3), (2, 3)]
    scores = [(100, 90), (80, 95), (None, None), (99, None), (70, 71), (90, 88)]
    rows = [(f"g{i}", 2009, "regular", d[i], *pairs[i], "final", *scores[i], False) for i in range(6)]
    games = one_pool(spark.createDataFrame(rows, GAME))
    rated = [r if r[7] is not None and r[8] is not None else (*r[:6], "scheduled", None, None, r[9]) for r in rows]
    expected = brute_elo(rated)
    for form in (ratings.stream_pools(games), ratings.rate_in_rounds(games, name="t-double", checkpoint_every=2)):
        assert form.count() == 6
        assert_rated(form, expected)
    assert sorted(r["game_id"] for r in ratings.unrated(games).collect()) == ["g2", "g3"]


def test_rating_is_zero_sum_and_resumes(spark):
    rows, games = small_league(spark)
    games = one_pool(games)
    rated = ratings.rate_games(games)
    drift = F.max(F.abs(F.col("home_elo_post") + F.col("away_elo_post") - F.col("home_elo_pre") - F.col("away_elo_pre")))
    assert rated.where("home_elo_post IS NOT NULL").agg(drift).first()[0] < 1e-9
    cut = sorted({r[3] for r in rows})[30]
    long = ratings.rating_rows(games, rated).where((F.col("game_date") < F.lit(cut)) & F.col("elo_post").isNotNull())
    start = long.groupBy("team_id").agg(F.max_by("elo_post", "game_date").alias("rating"), F.max_by("season", "game_date").alias("season"))
    later = ratings.rate_games(games.where(F.col("game_date") >= F.lit(cut)), start)
    ids = {r[0] for r in rows if r[3] >= cut}
    assert_rated(later, {k: v for k, v in brute_elo(rows).items() if k in ids})


def test_the_fold_reads_columns_and_needs_no_date():
    """Rows out of order of season, an unplayed game and a start rating, over two batches."""
    names = ratings.FOLDED
    rows = [
        ("1", "a", 2009, "x", "y", True, False, 5.0, 1600.0, 2008, np.nan, 0),
        ("1", "b", 2009, "y", "x", False, False, 0.0, np.nan, 0, np.nan, 0),
        ("1", "c", 2010, "x", "z", True, True, -3.0, 1600.0, 2008, np.nan, 0),
        ("2", "d", 2010, "x", "y", True, False, 2.0, np.nan, 0, np.nan, 0),
    ]
    batches = [pd.DataFrame(rows[:2], columns=names), pd.DataFrame(rows[2:], columns=names)]
    out = pd.concat(ratings._fold_pools(iter(batches))).set_index("game_id")
    carried = elo.SEASON_CARRYOVER * 1600 + (1 - elo.SEASON_CARRYOVER) * elo.SEASON_MEAN
    assert out.loc["a", "home_elo_pre"] == carried and out.loc["a", "away_elo_pre"] == elo.INITIAL
    assert out.loc["b", "home_elo_pre"] == out.loc["a", "away_elo_post"] and out.loc["b", "away_elo_pre"] == out.loc["a", "home_elo_post"]
    assert np.isnan(out.loc["b", "home_elo_post"]) and np.isnan(out.loc["b", "away_elo_post"])
    assert out.loc["c", "home_elo_pre"] == elo.SEASON_CARRYOVER * out.loc["a", "home_elo_post"] + (1 - elo.SEASON_CARRYOVER) * elo.SEASON_MEAN
    assert out.loc["d", "home_elo_pre"] == elo.INITIAL


def box_rows(rows):
    out = []
    for r in rows:
        if r[6] != "final":
            continue
        rng = random.Random(int(r[0]))
        for team, pts in ((r[4], r[7]), (r[5], r[8])):
            out.append((r[0], team, pts, 240, *(rng.randint(lo, lo + 10) for lo in (30, 8, 75, 15, 10, 8, 6, 28))))
    return out


BOX = "game_id string, team_id long, pts int, minutes int, fgm int, fg3m int, fga int, fta int, ftm int, tov int, oreb int, dreb int"


def features_of(spark, rows):
    games = one_pool(spark.createDataFrame(rows, GAME))
    stats = spark.createDataFrame(box_rows(rows), BOX)
    arenas = spark.createDataFrame([(t, 30.0 + t, -100.0 + 2 * t) for t in range(6)], "team_id long, lat double, lon double")
    moved = spark.createDataFrame([], "team_id long, season int, lat double, lon double")
    return {r["game_id"]: r for r in build_features(games, stats, arenas, moved, SHARED_SITE).collect()}


def test_tasks_of_features_follow_the_games(spark, monkeypatch):
    """More games give more tasks than the session's shuffle partitions, and the same features."""
    rows, _ = small_league(spark, days=20)
    expected = features_of(spark, rows)
    monkeypatch.setattr(features, "TASK_GAMES", 4)
    tasks = -(-len(rows) // 4)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = []
    windows = features.by_team
    monkeypatch.setattr(features, "by_team", lambda *args: counts.append(windows(*args)) or counts[-1])
    assert features_of(spark, rows) == expected
    assert [c.rdd.getNumPartitions() for c in counts] == [tasks]


def test_tasks_of_form_queries_follow_the_games(spark, monkeypatch):
    from boutline.catalog import sequences

    rows, _ = small_league(spark, days=20)
    games = one_pool(spark.createDataFrame(rows, GAME))
    prepared = games.withColumn("site_lat", F.lit(30.0)).withColumn("site_lon", F.lit(-100.0))
    box = spark.createDataFrame(box_rows(rows), BOX)
    league = SimpleNamespace(games=lambda: games, prepared=lambda: prepared, stats=lambda: box)
    expected = sorted(map(tuple, sequences.j2_played_with_box(league).collect()))
    monkeypatch.setattr(features, "TASK_GAMES", 4)
    tasks = -(-len(rows) // 4)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) and len(expected) > 0
    assert sequences._rows(league).rdd.getNumPartitions() == tasks
    assert sorted(map(tuple, sequences.j2_played_with_box(league).collect())) == expected


def test_features_do_not_see_the_future(spark):
    """Rewrite every result from a date on: earlier features stay, later ones move."""
    rows, _ = small_league(spark, days=40)
    cut = sorted({r[3] for r in rows})[20]
    changed = [
        (*r[:7], 150 - r[7], 155 - r[8], r[9]) if r[6] == "final" and r[3] >= cut else r for r in rows
    ]
    before, after = features_of(spark, rows), features_of(spark, changed)
    same = [g for g, r in before.items() if r["game_date"] <= cut]
    for g in same:
        for f in MODEL_FEATURES:
            assert before[g][f] == after[g][f], (g, f)
    later = [g for g, r in before.items() if r["game_date"] > cut + timedelta(days=5)]
    assert any(before[g]["home_elo_pre"] != after[g]["home_elo_pre"] for g in later)


def test_features_by_hand(spark):
    d = date(2010, 1, 1)
    rows = [
        ("a", 2009, "regular", d, 0, 1, "final", 100, 90, False),
        ("b", 2009, "regular", d + timedelta(days=1), 0, 2, "final", 80, 95, False),
        ("c", 2009, "playoffs", d + timedelta(days=3), 1, 0, "final", 99, 98, None),
        ("d", 2009, "regular", d + timedelta(days=9), 0, 1, "scheduled", None, None, True),
        ("e", 2010, "regular", date(2010, 10, 1), 0, 2, "scheduled", None, None, False),
    ]
    games = [(f"{i:06d}", *r[1:]) for i, r in enumerate(rows)]
    got = features_of(spark, games)
    a, b, c, dd, e = (got[f"{i:06d}"] for i in range(5))
    assert a["home_games_played"] == 0 and a["home_win_pct"] is None and a["home_rest_days"] == 7
    assert (b["home_games_played"], b["home_win_pct"], b["home_streak"], b["home_b2b"]) == (1, 1.0, 1, 1.0)
    assert (c["away_streak"], c["away_win_pct"], c["away_games_last7"], c["is_playoffs"]) == (-1, 0.5, 2, 1.0)
    assert (dd["home_streak"], dd["home_games_played"], dd["home_rest_days"], dd["is_neutral"]) == (-2, 3, 6, 1.0)
    assert dd["home_games_last7"] == 1 and dd["home_win"] is None
    # Next season: form resets, last season's net rating carries over.
    assert e["home_games_played"] == 0 and e["home_std_net"] is None and e["home_prev_net"] is not None
    assert e["home_rest_days"] == 7 and e["home_travel_km"] == 0.0
    assert e["home_elo_pre"] == pytest.approx(0.75 * c["away_elo_post"] + 0.25 * 1505)


def test_running_matches_brute_force_across_chunks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(-3, 3), rng.choice([None, None, 1, 2, 3])) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, i int, v int, x int")
    for inclusive in (True, False):
        out = running(df, ["k"], F.floor(F.col("i") / 7), ["i"], {"total": F.col("v")}, {"last": F.col("x")}, inclusive)
        for r in out.collect():
            seen = [q for q in rows if q[0] == r["k"] and (q[1] <= r["i"] if inclusive else q[1] < r["i"])]
            assert r["total"] == sum(q[2] for q in seen)
            known = [q[3] for q in seen if q[3] is not None]
            assert r["last"] == (known[-1] if known else None)
    # One key with most of the rows: even stretches, the same numbers.
    skewed = spark.createDataFrame([(0 if i % 10 else i, i % 7, i) for i in range(500)], "k int, t int, i int")
    cut = cut_by_range(skewed, ["k"], ["t", "i"], "t-skew")
    sizes = [r["count"] for r in cut.groupBy("chunk").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 200
    got = {r["i"]: r["rn"] for r in row_numbers(cut, ["k"], F.col("chunk"), ["t", "i"]).collect()}
    for k in {0, 10, 490}:
        ordered = sorted((i % 7, i) for i in range(500) if (0 if i % 10 else i) == k)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    ranks = row_numbers(df, [], F.col("k") * 10 + F.floor(F.col("i") / 20), ["k", "i"])
    assert all(r["rn"] == r["k"] * 50 + r["i"] + 1 for r in ranks.collect())


def test_asof_is_strict_unless_asked(spark):
    left = spark.createDataFrame([("t", d) for d in (1, 5, 6, 700)], "team string, day int")
    right = spark.createDataFrame([("t", 1, 10), ("t", 5, 50), ("u", 6, 60)], "team string, day int, v int")
    strict = {r["day"]: r["v"] for r in asof_backward(left, right, ["team"], "day", ["v"]).collect()}
    exact = {r["day"]: r["v"] for r in asof_backward(left, right, ["team"], "day", ["v"], allow_exact=True).collect()}
    assert strict == {1: None, 5: 10, 6: 50, 700: 50}
    assert exact == {1: 10, 5: 50, 6: 50, 700: 50}


EVENT = (
    "game_id string, action_id long, period int, clock_seconds double, score_home int, score_away int, "
    "action_type string, sub_type string, location string, description string"
)


@pytest.mark.parametrize(
    "kind,sub,side,text,before,after",
    [
        ("Made Shot", None, "h", None, 1, -1),
        ("Turnover", None, "v", None, -1, 1),
        ("Missed Shot", None, "h", None, 1, 0),
        ("Rebound", None, "v", None, 0, -1),
        ("Free Throw", "Free Throw 1 of 2", "h", None, -1, 1),
        ("Free Throw", "Free Throw 2 of 2", "h", "x makes", 1, -1),
        ("Free Throw", "Free Throw 2 of 2", "h", "MISS x", 1, 0),
        ("Free Throw", "Free Throw Technical", "v", None, 1, 1),
        ("Free Throw", "Free Throw Flagrant 2 of 2", "v", None, 1, -1),
        ("Free Throw", "odd", "v", None, 1, -1),
        ("Jump Ball", None, "h", None, 1, 0),
        ("period", None, None, None, -1, 0),
        ("Foul", None, "h", None, -1, -1),
        (None, None, "h", None, 1, 1),
        ("Made Shot", None, None, None, 1, 1),
    ],
)
def test_possession_rules(spark, kind, sub, side, text, before, after):
    lead = {1: ("Rebound", "h"), -1: ("Rebound", "v"), 0: ("Jump Ball", None)}[before]
    rows = [
        ("g", 1, 1, 700.0, 0, 0, lead[0], None, lead[1], None),
        ("g", 2, 1, 690.0, 0, 0, "Substitution", None, "v", None),
        ("g", 3, 1, 680.0, 0, 0, kind, sub, side, text),
    ]
    states = game_states(spark.createDataFrame(rows, EVENT)).orderBy("action_id").collect()
    assert [s["action_id"] for s in states] == [1, 3]
    assert states[-1]["possession"] == after


def test_thinning_is_even_and_idempotent(spark):
    sizes = {"long": 500, "short": 100, "live": 500}
    points = [(g, "live", i, i, 0.5) for g, n in sizes.items() for i in range(n)]
    points = spark.createDataFrame(points, "game_id string, source string, action_id long, id long, p double")
    games = spark.createDataFrame([("long", "final"), ("short", "final"), ("live", "live")], "game_id string, status string")
    once = thin(points, games, 150)
    kept = sorted(r["action_id"] for r in once.where("game_id = 'long'").collect())
    assert kept[0] == 0 and kept[-1] == 499 and len(kept) == 150
    assert {b - a for a, b in zip(kept, kept[1:])} <= {3, 4}
    assert once.where("game_id = 'short'").count() == 100 and once.where("game_id = 'live'").count() == 500
    assert thin(once, games, 150).count() == once.count()
    one = spark.createDataFrame([("long", "live", 0, 0, 0.5)], points.schema)
    assert thin(one, games, 150).count() == 1
    assert all(thin(points, games, off).count() == points.count() for off in (0, None))


def test_upsert_writes_only_given_columns(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, x string, y int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, x string")
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {(1, "a", 10), (2, None, 20), (3, "c", None)}
    guarded = upsert(old, new, ["k"], guard=lambda o, n: n("x").isNotNull())
    assert {tuple(r) for r in guarded.collect()} == {(1, "a", 10), (2, "b", 20), (3, "c", None)}


def test_metrics_known_values(spark):
    from boutline.operators.evaluation import metric_summary, reliability

    rows = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (1.0, 0.5), (0.0, 0.3)], "y double, p double")
    m = metric_summary(rows, []).first()
    expected = -(2 * math.log(0.999) + math.log(0.5) + math.log(0.7)) / 4
    assert m["logloss"] == pytest.approx(expected) and m["brier"] == pytest.approx((0.25 + 0.09) / 4)
    assert m["accuracy"] == 1.0 and m["n"] == 4 and m["ece"] == pytest.approx((0.5 + 0.3) / 4)
    curve = {r["bin_low"]: r["count"] for r in reliability(rows, []).collect()}
    assert curve == {0.0: 1, 0.3: 1, 0.5: 1, 0.9: 1}


def test_league_keeps_every_order(spark, league):
    """Every order is a game, and still no team plays twice on a date or leaves its pool."""
    games = league.games()
    rows = games.select("game_id", "pool", "game_date", F.explode(F.array("home_team_id", "away_team_id")).alias("t"))
    assert games.count() == league.table("orders").count() and games.where("home_team_id = away_team_id").count() == 0
    assert rows.groupBy("t", "game_date").count().where("count > 1").count() == 0
    assert rows.groupBy("t").agg(F.count_distinct("pool").alias("n")).where("n > 1").count() == 0
    assert league.events().count() == league.table("events").count()
    assert league.events().join(games, "game_id").select("season").distinct().count() >= 4
    listed = [
        (r["game_id"], r["season"], None, r["game_date"], r["home_team_id"], r["away_team_id"], r["status"], r["home_score"], r["away_score"], r["is_neutral"])
        for r in league.prepared().collect()
    ]
    assert_rated(ratings.rate_games(league.prepared()), brute_elo(listed))


def test_ratings_from_the_earliest_change_on_equal_the_whole_fold(spark, monkeypatch):
    rng = np.random.default_rng(12)
    schema = "game_id string, game_date date, season int, home_team_id long, away_team_id long, status string, home_score int, away_score int, is_neutral boolean"

    def game(i, day):
        home, away = rng.permutation(8)[:2].tolist()
        played = day < 60
        return [f"g{i:03}", date(2000, 1, 1) + timedelta(days=day * 7), 2000 + day // 25, home, away, "final" if played else "scheduled", *(rng.integers(80, 120, 2).tolist() if played else (None, None)), False]

    games = {r[0]: r for r in (game(i, i // 3) for i in range(200))}
    frame = lambda rows: spark.createDataFrame([tuple(r) for r in rows.values()], schema).withColumn("pool", F.lit("p"))
    folded = []
    real = ratings.stream_pools
    monkeypatch.setattr(ratings, "stream_pools", lambda g, start=None: folded.append(g.count()) or real(g, start))
    columns = ["game_id", "home_elo_pre", "away_elo_pre", "home_elo_post", "away_elo_post"]
    values = lambda df: {r["game_id"]: tuple(r) for r in df.select(columns).collect()}
    stored = ratings.rating_rows(frame(games), real(frame(games))).cache()
    before = ratings.rating_inputs(frame(games)).cache()

    def since(changed):
        day = ratings.first_change(ratings.rating_inputs(frame(changed)), before)
        got, want = values(ratings.rate_since(frame(changed), stored, day)), values(real(frame(changed)))
        assert got.keys() == want.keys()
        for key, row in want.items():
            assert got[key] == pytest.approx(row), key
        return day

    assert since(games) is None and folded == []
    late = {**games, "new": game(999, 40)}
    late["new"][0] = "new"
    other = {**games, "g100": [*games["g100"][:6], 70, 150, False]}
    gone = {k: v for k, v in games.items() if k != "g030"}
    moved = {**games, "g120": [games["g120"][0], date(2000, 2, 1), *games["g120"][2:]]}
    for changed, first in ((late, late["new"][1]), (other, games["g100"][1]), (gone, games["g030"][1]), (moved, date(2000, 2, 1))):
        assert since(changed) == first
        assert folded.pop() == sum(r[1] >= first for r in changed.values())
    # A new fixture of the future: only what comes from that day on is folded.
    future = {**games, "zz": game(998, 66)}
    future["zz"][0] = "zz"
    since(future)
    assert folded.pop() <= 4


def test_a_team_against_itself_is_not_rated(spark):
    rows = [("a", date(2000, 1, 1), 2000, 1, 1, "final", 9, 8), ("b", date(2000, 1, 1), 2000, 1, 2, "final", 9, 8)]
    games = spark.createDataFrame(rows, "game_id string, game_date date, season int, home_team_id long, away_team_id long, status string, home_score int, away_score int")
    games = games.select("*", F.lit(False).alias("is_neutral"), F.lit("p").alias("pool"))
    for form in (ratings.stream_pools(games), ratings.rate_in_rounds(games, name="t-itself")):
        got = {r["game_id"]: r for r in form.collect()}
        assert got["a"]["home_elo_post"] is None and got["b"]["home_elo_post"] > got["b"]["home_elo_pre"] == 1500.0
    assert [r["game_id"] for r in ratings.unrated(games).collect()] == ["a"]
