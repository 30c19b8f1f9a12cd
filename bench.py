"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then timed; `core_tables` is the one-off build of the
stored tables (games, box scores, events, ratings) that the queries read. Every result is fully
computed and discarded."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = [
    "team_form",
    "w13_game_features",
    "r1_elo",
    "r1_elo_incremental",
    "j3_asof_general",
    "u3_tip_off",
    "m9_training_states",
    "a7_by_season_and_pooled",
    "m19_monitor",
    "j7_lateral_latest",
    "j19_pregame_estimate",
    "s11_guarded_upsert",
    "t3_recent_upcoming",
    "w10_thinning",
    "x12_replay",
]


def main() -> None:
    from boutline.catalog import QUERIES
    from boutline.fixtures import SHARED_SITE, league
    from boutline.operators.features import build_features
    from boutline.operators.ratings import rate_games
    from boutline.session import local_session

    spark = local_session(CPUS, "bench", os.environ.get("BENCH_MEMORY", "8g"))

    def run(df) -> float:
        started = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    def timed(build) -> float:
        times = []
        for _ in range(REPEATS + 1):
            started = time.perf_counter()
            run(build())
            times.append(time.perf_counter() - started)
        return round(statistics.median(times[1:]), 3)

    seconds: dict[str, float] = {}
    started = time.perf_counter()
    league_ = league(spark, SF_DIR)
    for view in ("games", "stats", "events", "states", "rated", "features", "snapshots"):
        getattr(league_, view)()
    seconds["core_tables"] = round(time.perf_counter() - started, 3)
    for name in HEADLINE:
        seconds[name] = timed(lambda name=name: QUERIES[name](spark, SF_DIR))
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    # The nightly work over the whole league: every order a game, one rating pool per nation.
    games = league_.games()
    seconds["rating"] = timed(lambda: rate_games(league_.prepared()))
    seconds["features"] = timed(
        lambda: build_features(games, league_.stats(), league_.arenas(), league_.relocations(), SHARED_SITE)
    )
    n = games.count()
    line = {
        "metric": "headline queries, total warm seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "games": n,
        "feature_games_per_sec": round(n / seconds["features"], 1),
        "rating_games_per_sec": round(n / seconds["rating"], 1),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
