"""A league derived from the star-schema tables: every operator gets realistic rows whose
volume follows the tables. Formulas use integer arithmetic so that any engine agrees exactly.

Views that many queries share are written once per application to the shared folder, as the
stored tables a deployment would read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions.box import OWN
from boutline.functions.calendar import season_of
from boutline.operators.features import build_features
from boutline.operators.ratings import rate_games, rating_rows
from boutline.operators.running import cut_by_range, row_numbers, running
from boutline.operators.states import game_states, with_times
from boutline.operators.teamgames import SharedSite, prepare_games
from boutline.session import materialise

SHARED_SITE = SharedSite(season=1999, start=date(2000, 7, 1), lat=28.5, lon=-81.4)
TODAY = date(2001, 5, 20)


def div(a: Column, b: Column | int) -> Column:
    """Integer division of non-negative numbers."""
    return F.floor(a / b).cast("long")


class League:
    """Fixture views over one data folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _tag(self) -> str:
        return hashlib.sha1(self.sf_dir.encode()).hexdigest()[:12]

    def _stored(self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
        if name not in self._views:
            self._views[name] = materialise(build(), f"{self._tag()}/{name}", partition_by)
        return self._views[name]

    # ------------------------------------------------------------ meetings

    def _ring(self) -> DataFrame:
        """(c_custkey, nation, rank, size): the customers of a nation, which are the teams that
        play each other, numbered from 0."""
        customer = self.table("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"))
        ranked = row_numbers(customer, ["nation"], F.floor(F.col("c_custkey") / 4096), ["c_custkey"], name="rank")
        sizes = customer.groupBy("nation").agg(F.count(F.lit(1)).alias("size"))
        return ranked.withColumn("rank", F.col("rank") - 1).join(sizes, "nation")

    def _meetings(self) -> DataFrame:
        """(ok, d, h, a, pool, priority): who meets whom, one row per order.

        A team plays once per date although every order is kept. The kth order of each customer in
        a stretch of 30 days is a round of its nation: everyone meets the team `step` places on in
        the ring, on the first of the round's three dates in even runs of `step` places, on the
        second in odd runs, and on the third where the ring closes."""
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("ok"),
            F.col("o_custkey").alias("c_custkey"),
            F.to_date("o_orderdate").alias("od"),
            F.col("o_orderpriority").alias("priority"),
        )
        stretch = div(F.datediff("od", F.lit("1992-01-01").cast("date")), 30)
        numbered = row_numbers(
            orders.withColumn("stretch", stretch), ["c_custkey", "stretch"], F.floor(F.col("ok") / 65536), ["ok"], name="k"
        ).withColumn("k", F.col("k") - 1)
        ring = self._ring()
        rank, size = F.col("rank"), F.col("size")
        step = 1 + (F.col("stretch") + F.col("k")) % div(size, 2)
        placed = numbered.join(ring, "c_custkey").withColumn("step", step)
        third = F.when(rank >= size - F.col("step"), 2).otherwise(div(rank, F.col("step")) % 2)
        day = (F.col("stretch") * 30 + F.col("k") * 3 + third).cast("int")
        targets = placed.select(
            "ok", "priority", "nation", F.date_add(F.lit("1992-01-01").cast("date"), day).alias("d"), F.col("c_custkey").alias("h"),
            ((rank + F.col("step")) % size).alias("target"),
        )
        opponents = ring.select("nation", F.col("rank").alias("target"), F.col("c_custkey").alias("a"))
        return targets.join(opponents, ["nation", "target"]).select(
            "ok", "d", "priority", "h", "a", F.col("nation").cast("string").alias("pool")
        )

    def _sides(self) -> DataFrame:
        """Meetings with both teams' box lines."""
        quantity = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("ok"))
            .agg(F.sum("l_quantity").cast("long").alias("q"))
        )
        base = self._meetings().join(quantity, "ok", "left")

        def line(team: str, side: int) -> dict[str, Column]:
            t, ok = F.col(team), F.col("ok")
            x = F.coalesce(F.col("q"), F.lit(0)) * 7 + ok * 31 + t * 101
            fgm = 32 + (x * 3) % 16 + (t * 7) % 11 - 5 + side
            return {
                "minutes": F.when(ok % 16 == 0, 265).otherwise(240),
                "fgm": fgm,
                "fga": 75 + x % 20,
                "fg3m": 8 + (x * 7) % 10,
                "fg3a": 25 + (x * 5) % 15,
                "ftm": 10 + (x * 13) % 5,
                "fta": 15 + (x * 11) % 15,
                "oreb": 6 + (x * 17) % 9,
                "dreb": 28 + (x * 19) % 12,
                "tov": 8 + (x * 23) % 10,
            }

        lines = {"h": line("h", 1), "a": line("a", 0)}
        wide = base.select("*", *[e.alias(f"{s}_{c}") for s, cols in lines.items() for c, e in cols.items()])
        for s in ("h", "a"):
            wide = wide.withColumn(f"{s}_pts", 2 * F.col(f"{s}_fgm") + F.col(f"{s}_fg3m") + F.col(f"{s}_ftm"))
        tie = (F.col("h_pts") == F.col("a_pts")).cast("long")
        return wide.withColumn("__tie", tie).withColumn("h_ftm", F.col("h_ftm") + F.col("__tie")).withColumn(
            "h_pts", F.col("h_pts") + F.col("__tie")
        ).drop("__tie")

    def sides(self) -> DataFrame:
        return self._stored("sides", self._sides)

    def games(self) -> DataFrame:
        def build() -> DataFrame:
            ok, d = F.col("ok"), F.col("d")
            status = (
                F.when((d >= F.lit("2001-06-01").cast("date")) | (ok % 40 == 0), "scheduled")
                .when(d >= F.lit("2001-05-25").cast("date"), "live")
                .otherwise("final")
            )
            tip = F.timestamp_seconds((F.unix_date(d).cast("long") * 24 + 22 + ok % 5) * 3600)
            rows = self.sides().select(
                F.lpad(ok.cast("string"), 10, "0").alias("game_id"),
                "ok",
                season_of(d).alias("season"),
                F.when(F.col("priority") == "1-URGENT", "playoffs")
                .when(F.col("priority") == "2-HIGH", "playin")
                .otherwise("regular")
                .alias("season_type"),
                d.alias("game_date"),
                F.when(ok % 17 != 0, tip).alias("tip_time_utc"),
                F.col("h").alias("home_team_id"),
                F.col("a").alias("away_team_id"),
                status.alias("status"),
                F.when(status != "scheduled", F.col("h_pts")).alias("home_score"),
                F.when(status != "scheduled", F.col("a_pts")).alias("away_score"),
                F.when(ok % 7 != 0, ok % 50 == 0).alias("is_neutral"),
                F.when(ok % 3 != 0, F.concat(F.lit("e"), ok.cast("string"))).alias("provider_id"),
                "pool",
            )
            return rows

        return self._stored("games", build)

    def stats(self) -> DataFrame:
        def build() -> DataFrame:
            def side(s: str, o: str) -> Column:
                line = [F.col(f"{s}_{c}").alias(c) for c in [*OWN, "fg3a"]]
                return F.struct(
                    F.col(s).alias("team_id"),
                    F.lit(s == "h").alias("is_home"),
                    *line,
                    (F.col(f"{s}_pts") - F.col(f"{o}_pts")).alias("plus_minus"),
                )

            return (
                self.sides()
                .where("q IS NOT NULL")
                .select(
                    F.lpad(F.col("ok").cast("string"), 10, "0").alias("game_id"),
                    F.explode(F.array(side("h", "a"), side("a", "h"))).alias("s"),
                )
                .select("game_id", "s.*")
            )

        return self._stored("team_game_stats", build)

    # ------------------------------------------------------------ dimensions

    def teams(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("team_id"),
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("abbreviation"),
            F.col("c_name").alias("full_name"),
        )

    def arenas(self) -> DataFrame:
        team = F.col("team_id")
        return self.teams().select(
            "team_id",
            (25 + team % 25).cast("double").alias("lat"),
            (-120 + 2 * (team % 25)).cast("double").alias("lon"),
        )

    def relocations(self) -> DataFrame:
        return self.arenas().where("team_id = 3").select(
            "team_id", F.lit(1996).alias("season"), F.lit(47.6).alias("lat"), F.lit(-122.4).alias("lon")
        )

    def prepared(self) -> DataFrame:
        return prepare_games(self.games(), self.arenas(), self.relocations(), SHARED_SITE)

    # ------------------------------------------------------------ events

    def events(self) -> DataFrame:
        def build() -> DataFrame:
            raw = self.table("events").select(
                "event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k")
            )
            # Even stretches of (user, time): no busy user or hour is numbered by one task.
            cut = cut_by_range(raw, ["user_id"], ["ts", "event_id"], f"{self._tag()}/events")
            numbered = row_numbers(cut, ["user_id"], F.col("chunk"), ["ts", "event_id"], name="action_id").drop("chunk")
            counts = raw.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
            # By order, not by date: the games with events are spread over the seasons.
            order = row_numbers(self.games().select("game_id", "ok"), [], F.floor(F.col("ok") / 65536), ["ok"])
            of_user = order.select("game_id", (F.col("rn") - 1).alias("user_id"))
            rows = numbered.join(counts, "user_id").join(of_user, "user_id")
            kind, k, n = F.col("event_type"), F.col("k"), F.col("n")
            error = F.array(*[F.lit(v) for v in ("Jump Ball", "Substitution", "Timeout", "period", None, "Foul")])
            action = (
                F.when(kind == "click", "Made Shot")
                .when(kind == "view", "Missed Shot")
                .when(kind == "purchase", "Rebound")
                .when(kind == "signup", F.when(k % 4 == 0, "Turnover").otherwise("Free Throw"))
                .otherwise(F.get(error, (k % 6).cast("int")))
            )
            trips = F.array(
                *[
                    F.lit(f"Free Throw {v}")
                    for v in ("1 of 2", "2 of 2", "Technical", "Flagrant 2 of 2", "Clear Path 1 of 1")
                ]
            )
            periods = F.when(F.col("user_id") % 10 == 0, 5).otherwise(4)
            step = periods * (F.col("action_id") - 1)
            period = 1 + div(step, n)
            length = F.when(period == 5, 300).otherwise(720)
            rows = rows.select(
                "game_id",
                "user_id",
                "event_id",
                "action_id",
                "k",
                action.alias("action_type"),
                F.when((F.col("event_id") % 13 != 0) & ~action.eqNullSafe("period"), F.when(F.col("event_id") % 2 == 0, "h").otherwise("v")).alias("location"),
                F.when(action == "Free Throw", F.get(trips, (k % 5).cast("int"))).alias("sub_type"),
                F.when(k % 3 == 0, "MISS x").otherwise("ok x").alias("description"),
                period.cast("int").alias("period"),
                ((10 * length - div(step * 10 * length, n) % (10 * length)) / 10.0).alias("clock_seconds"),
            )
            points = (
                F.when(F.col("action_type") == "Made Shot", 2 + (F.col("k") % 3 == 0).cast("int"))
                .when((F.col("action_type") == "Free Throw") & (F.col("k") % 3 != 0), 1)
                .otherwise(0)
            )
            scored = running(
                rows.withColumn("points", points),
                ["game_id"],
                F.floor(F.col("action_id") / 65536),
                ["action_id"],
                sums={
                    "score_home": F.when(F.col("location") == "h", points).otherwise(0),
                    "score_away": F.when(F.col("location") == "v", points).otherwise(0),
                },
            )
            return scored.withColumn("score_home", F.col("score_home").cast("int")).withColumn(
                "score_away", F.col("score_away").cast("int")
            )

        return self._stored("pbp_events", build)

    def states(self) -> DataFrame:
        return self._stored("states", lambda: with_times(game_states(self.events())))

    # ------------------------------------------------------------ derived tables

    def rated(self) -> DataFrame:
        return self._stored("rated", lambda: rate_games(self.prepared()))

    def ratings(self) -> DataFrame:
        return rating_rows(self.games(), self.rated())

    def features(self) -> DataFrame:
        return self._stored(
            "game_features",
            lambda: build_features(
                self.games(), self.stats(), self.arenas(), self.relocations(), SHARED_SITE, self.rated()
            ),
        )

    def predictions(self) -> DataFrame:
        """Between one and four predictions per game, three hours apart."""
        ok, j = F.col("ok"), F.col("j")
        rows = self.games().select(
            "game_id", "ok", "game_date", "tip_time_utc", F.explode(F.sequence(F.lit(0), (ok % 4).cast("int"))).alias("j")
        )
        created = F.timestamp_seconds((F.unix_date("game_date").cast("long") * 24 + 18 + 3 * j) * 3600)
        midnight = F.timestamp_seconds((F.unix_date("game_date").cast("long") + 1) * 86400)
        names = F.array(*[F.lit(n) for n in ("home_elo_pre", "diff_std_net", "away_rest_days")])
        factors = F.transform(
            names,
            lambda name, i: F.struct(
                name.alias("feature"),
                F.when((ok + j + i) % 3 != 0, ((ok + i * 7) % 50).cast("double")).alias("value"),
                (((ok * 13 + j + i * 29) % 41 - 20) / 10.0).alias("contribution"),
            ),
        )
        return rows.select(
            (ok * 10 + j).alias("id"),
            "game_id",
            F.when(j < 2, "7").otherwise("10").alias("model_version"),
            (((ok * 37 + j * 211) % 97 + 1) / 98.0).alias("home_win_prob"),
            created.alias("created_at"),
            (created < F.coalesce("tip_time_utc", midnight)).alias("made_before_tip"),
            factors.alias("factors"),
        )

    def snapshots(self) -> DataFrame:
        """Live points of tracked games and replays of some of them."""
        def build() -> DataFrame:
            users = self.events().select("game_id", "user_id").distinct()
            points = self.states().join(users, "game_id")
            sources = F.filter(
                F.array(F.when(F.col("user_id") % 3 != 0, "live"), F.when(F.col("user_id") % 2 == 0, "replay")),
                lambda s: s.isNotNull(),
            )
            rows = points.withColumn("source", F.explode(sources))
            margin = F.col("score_home") - F.col("score_away")
            return rows.select(
                ((F.col("user_id") * 1_000_000 + F.col("action_id")) * 2 + (F.col("source") == "replay").cast("int")).alias("id"),
                "game_id",
                "source",
                F.when(F.col("user_id") % 5 == 0, "3").otherwise("4").alias("model_version"),
                "action_id",
                "period",
                "clock_seconds",
                "elapsed_seconds",
                "score_home",
                "score_away",
                "possession",
                F.round(1.0 / (1.0 + F.exp(-0.15 * margin)), 6).alias("home_win_prob"),
            )

        return self._stored("live_wp_snapshots", build)


_LEAGUES: dict[tuple[str, str], League] = {}


def league(spark: SparkSession, sf_dir: str) -> League:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _LEAGUES:
        _LEAGUES[key] = League(spark, sf_dir)
    return _LEAGUES[key]
