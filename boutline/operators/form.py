"""Form before a game: running state, as-of attachment, schedule load.

A team plays at most once per date, so a team's rows are bounded by the calendar (366 a
season); windows keyed by team are therefore safe. Run in the order state, previous season,
load, as-of, they share one shuffle by `team_id` and two sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.functions.box import RATE_INPUTS, haversine_km, rate_sql

WINDOWS = {"std": None, "l10": 10, "l5": 5}
MAX_REST_DAYS = 7

# Rates carried in the state, per window.
STATE_RATES = {
    "std": [
        "ortg", "drtg", "net", "pace", "efg", "tov_pct", "orb_pct", "ftr",
        "opp_efg", "opp_tov_pct", "drb_pct", "opp_ftr",
    ],
    "l10": ["ortg", "drtg", "net", "efg", "opp_efg"],
    "l5": ["net"],
}
STATE = ["games_played", "win_pct", "streak", *[f"{w}_{r}" for w, names in STATE_RATES.items() for r in names]]


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.unix_date("game_date"))


def by_team(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows with their day number, shuffled by team once for all windows. The count is explicit:
    windows cost far more than their bytes suggest, so small shuffles must not be merged."""
    partitions = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_day(rows).repartition(partitions, "team_id")


def post_game_state(rows: DataFrame, rates_of: dict[str, list[str]] | None = None) -> DataFrame:
    """Season-to-date and rolling form *after* each played game with a box score (`has_state`);
    other rows get NULL state. Rates are ratios of the summed components; `rates_of` names the
    rates wanted per window (default: those of STATE)."""
    wanted = STATE_RATES if rates_of is None else rates_of
    # Rows without state form their own partitions, so frames count played games only.
    over = "OVER (PARTITION BY team_id, season, has_state ORDER BY day, game_id ROWS BETWEEN {} AND CURRENT ROW)"
    so_far = over.format("UNBOUNDED PRECEDING")
    sums = [
        f"sum(CAST({c} AS BIGINT)) {over.format(f'{WINDOWS[w] - 1} PRECEDING') if WINDOWS[w] else so_far} AS __{w}_{c}"
        for w, names in wanted.items()
        for c in dict.fromkeys(c for name in names for c in RATE_INPUTS[name])
    ]
    rows = rows.selectExpr("*", "coalesce(status = 'final' AND has_box, false) AS has_state")
    kept = rows.columns
    rows = rows.selectExpr("*", f"row_number() {so_far} AS __n", f"sum(win) {so_far} AS __wins", *sums)
    # Streak without islands: distance to the last game that went the other way.
    out = {
        "games_played": "__n",
        "win_pct": "__wins / __n",
        "streak": f"""CASE WHEN win = 1 THEN __n - coalesce(max(CASE WHEN win = 0 THEN __n END) {so_far}, 0)
            ELSE coalesce(max(CASE WHEN win = 1 THEN __n END) {so_far}, 0) - __n END""",
    }
    for w, names in wanted.items():
        out |= {f"{w}_{name}": rate_sql(name, f"__{w}_") for name in names}
    return rows.selectExpr(
        *kept, *[f"CASE WHEN has_state THEN CAST({e} AS DOUBLE) END AS {n}" for n, e in out.items()]
    )


def previous_season(rows: DataFrame) -> DataFrame:
    """Add last season's closing net rating: seasons are one apart, so a range of exactly -1. It
    reads rows sorted by (team, season), the order `post_game_state` leaves them in."""
    last_season = Window.partitionBy("team_id").orderBy("season").rangeBetween(-1, -1)
    closing = F.max_by("std_net", F.when(F.col("std_net").isNotNull(), F.col("day")))
    return rows.withColumn("prev_net", closing.over(last_season))


def attach_state(rows: DataFrame, states: list[str] = STATE) -> DataFrame:
    """The team's latest state strictly before each game; NULL when that state belongs to another
    season. `rows` already hold every state, so the as-of join is one window over themselves."""
    earlier = Window.partitionBy("team_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    packed = F.when(F.col("has_state"), F.struct(F.col("season"), *states))
    rows = rows.withColumn("__state", F.last(packed, ignorenulls=True).over(earlier))
    attached = {s: f"CASE WHEN __state.season = season THEN __state.{s} END" for s in states}
    if "games_played" in attached:
        attached["games_played"] = f"coalesce({attached['games_played']}, 0D)"
    return rows.selectExpr(
        *[c for c in rows.columns if c not in states and c != "__state"], *[f"{e} AS {s}" for s, e in attached.items()]
    )


def schedule_load(rows: DataFrame) -> DataFrame:
    """Rest, back-to-backs, games in the last 7 days and travel, over all games of a team."""
    order = Window.partitionBy("team_id").orderBy("day", "game_id")
    until = Window.partitionBy("team_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -8)
    before = F.lag(F.struct("day", "season", "site_lat", "site_lon")).over(order)
    rows = rows.select(
        "*", before.alias("__p"), F.row_number().over(order).alias("__n"), F.count(F.lit(1)).over(until).alias("__old")
    )
    same = F.coalesce(F.col("__p.season") == F.col("season"), F.lit(False))
    days = F.col("day") - F.col("__p.day")
    rest = F.when(same, F.least(days, F.lit(MAX_REST_DAYS))).otherwise(MAX_REST_DAYS)
    travel = haversine_km(F.col("__p.site_lat"), F.col("__p.site_lon"), F.col("site_lat"), F.col("site_lon"))
    return rows.select(
        *[c for c in rows.columns if not c.startswith("__")],
        rest.cast("double").alias("rest_days"),
        (rest == 1).cast("double").alias("b2b"),
        (F.col("__n") - 1 - F.col("__old")).cast("double").alias("games_last7"),
        F.when(same, travel).otherwise(0.0).alias("travel_km"),
    )
