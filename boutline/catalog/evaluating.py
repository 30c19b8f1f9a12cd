"""Metrics, acceptance, promotion, monitoring."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.catalog.base import query
from boutline.fixtures import TODAY, League
from boutline.functions import elo, prob
from boutline.operators import evaluation as ev
from boutline.operators.features import labelled
from boutline.operators.states import with_inputs, with_times
from boutline.plans import monitor, rules, serving

# Final games with two forecasts: the rating baseline and a stand-in model.
_LONG = """(SELECT f.game_id, f.season, home_win AS y, 1/(1+pow(10.0::DOUBLE, -(home_elo_pre + CASE WHEN f.is_neutral = 1 THEN 0 ELSE 100 END - away_elo_pre)/400)) AS elo,
    ((ok*37) % 97 + 1)/98.0::DOUBLE AS model FROM features f JOIN games g USING (game_id) WHERE f.status = 'final' AND f.season >= 1996)"""
_VARIANTS = f"(SELECT game_id, season, y, 'elo' AS variant, elo AS p FROM {_LONG} UNION ALL SELECT game_id, season, y, 'model', model FROM {_LONG})"
_CLIP = "least(greatest(p, 0.001::DOUBLE), 0.999::DOUBLE)"
_LOSS = f"-avg(y*ln({_CLIP}) + (1-y)*ln(1-{_CLIP}))"
_BIN = "least(CAST(floor(p*10) AS INTEGER), 9)"


def _metrics_sql(source: str, keys: list[str]) -> str:
    """Metrics by an independent route: bin curve and row averages joined by key."""
    k = ", ".join(keys)
    lead = f"{k}, " if keys else ""
    group = f"GROUP BY {k}" if keys else ""
    on = f"USING ({k})" if keys else "ON true"
    bins = f"SELECT {lead}{_BIN} AS bin, avg(p) AS mp, avg(y) AS my, count(*) AS c FROM {source} GROUP BY {lead}bin"
    return f"""SELECT * FROM (SELECT {lead}{_LOSS} AS logloss, avg(pow(p-y,2)) AS brier,
        avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM {source} {group})
        JOIN (SELECT {lead}sum(c*abs(mp-my))/sum(c) AS ece FROM ({bins}) {group}) {on}"""


_METRICS = "logloss brier accuracy ece"


def variants(L: League) -> DataFrame:
    rows = labelled(L.features(), 1996).join(L.games().select("game_id", "ok"), "game_id")
    baseline = elo.home_win_probability(F.col("home_elo_pre"), F.col("away_elo_pre"), F.col("is_neutral") == 1)
    forecasts = F.create_map(F.lit("elo"), baseline, F.lit("model"), ((F.col("ok") * 37) % 97 + 1) / 98.0)
    return rows.select("game_id", "season", F.col("home_win").alias("y"), F.explode(forecasts).alias("variant", "p"))


@query("a1_log_loss", f"SELECT variant, {_LOSS} AS logloss FROM {_VARIANTS} GROUP BY 1", "logloss")
def a1_log_loss(L: League) -> DataFrame:
    return variants(L).groupBy("variant").agg(F.avg(prob.log_loss_term(F.col("y"), F.col("p"))).alias("logloss"))


@query("a2_brier", f"SELECT variant, avg((p-y)*(p-y)) AS brier FROM {_VARIANTS} GROUP BY 1", "brier")
def a2_brier(L: League) -> DataFrame:
    return variants(L).groupBy("variant").agg(F.avg(prob.brier_term(F.col("y"), F.col("p"))).alias("brier"))


@query("a3_accuracy", f"SELECT variant, CAST(count(*) FILTER (WHERE (p >= 0.5) = (y = 1)) AS DOUBLE)/count(*) AS accuracy FROM {_VARIANTS} GROUP BY 1", "accuracy")
def a3_accuracy(L: League) -> DataFrame:
    return variants(L).groupBy("variant").agg(F.avg(prob.hit_term(F.col("y"), F.col("p"))).alias("accuracy"))


@query(
    "a4_reliability",
    f"""SELECT variant, b/10.0::DOUBLE AS bin_low, (b+1)/10.0::DOUBLE AS bin_high, avg(p) AS mean_pred, avg(y) AS observed, count(*) AS count
        FROM (SELECT *, {_BIN} AS b FROM {_VARIANTS}) GROUP BY variant, b""",
    "bin_low bin_high mean_pred observed",
)
def a4_reliability(L: League) -> DataFrame:
    return ev.reliability(variants(L), ["variant"])


@query("a5_ece", f"SELECT variant, ece FROM ({_metrics_sql(_VARIANTS, ['variant'])})", "ece")
def a5_ece(L: League) -> DataFrame:
    return ev.metric_summary(variants(L), ["variant"]).select("variant", "ece")


@query("a6_metric_summary", _metrics_sql(_VARIANTS, ["variant"]), _METRICS)
def a6_metric_summary(L: League) -> DataFrame:
    return ev.metric_summary(variants(L), ["variant"])


_POOLED = f"SELECT variant, season, logloss, brier, accuracy, ece, n FROM ({_metrics_sql(_VARIANTS, ['variant', 'season'])}) UNION ALL SELECT variant, NULL, logloss, brier, accuracy, ece, n FROM ({_metrics_sql(_VARIANTS, ['variant'])})"


@query("a7_by_season_and_pooled", _POOLED, _METRICS)
def a7_by_season_and_pooled(L: League) -> DataFrame:
    return ev.season_and_pooled(variants(L))


_STATE_P = """(SELECT s.game_id, s.action_id, CASE WHEN period <= 4 AND seconds_remaining > 2160 AND seconds_remaining <= 2880 THEN 'Q1' WHEN period <= 4 AND seconds_remaining > 1440 AND seconds_remaining <= 2160 THEN 'Q2'
     WHEN period <= 4 AND seconds_remaining > 720 AND seconds_remaining <= 1440 THEN 'Q3' WHEN period <= 4 AND seconds_remaining > 0 AND seconds_remaining <= 720 THEN 'Q4' END AS quarter,
     CASE WHEN home_score > away_score THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, home_win_prob AS p
     FROM snaps s JOIN (SELECT game_id, action_id AS act, seconds_remaining FROM states) t ON t.game_id = s.game_id AND t.act = s.action_id JOIN games g ON g.game_id = s.game_id WHERE g.status = 'final')"""


def _ingame(L: League) -> DataFrame:
    games = L.games().where("status = 'final'").select(
        "game_id", (F.col("home_score") > F.col("away_score")).cast("double").alias("y")
    )
    points = with_times(L.snapshots().drop("elapsed_seconds")).join(games, "game_id")
    return points.withColumn("quarter", ev.quarter_of()).withColumn("p", F.col("home_win_prob"))


@query("a8_by_quarter", f"SELECT * FROM ({_metrics_sql(_STATE_P, ['quarter'])}) WHERE quarter IS NOT NULL", _METRICS)
def a8_by_quarter(L: League) -> DataFrame:
    return ev.metric_summary(_ingame(L).where("quarter IS NOT NULL"), ["quarter"])


@query("a9_distinct_games", "SELECT source, count(DISTINCT game_id) AS games FROM snaps GROUP BY 1")
def a9_distinct_games(L: League) -> DataFrame:
    return L.snapshots().groupBy("source").agg(F.count_distinct("game_id").alias("games"))


@query(
    "a10_frequent_version",
    "SELECT season, min(model_version) AS version FROM (SELECT *, max(c) OVER (PARTITION BY season) AS mc FROM (SELECT season, model_version, count(*) AS c FROM predictions JOIN games USING (game_id) GROUP BY 1, 2)) WHERE c = mc GROUP BY 1",
)
def a10_frequent_version(L: League) -> DataFrame:
    rows = L.predictions().join(L.games().select("game_id", "season"), "game_id")
    return rows.groupBy("season").agg(F.mode("model_version", True).alias("version"))


@query("a11_big_seasons", "SELECT season, count(*) AS games FROM games WHERE status = 'final' GROUP BY 1 HAVING count(*) >= 1000")
def a11_big_seasons(L: League) -> DataFrame:
    counts = L.games().where("status = 'final'").groupBy("season").agg(F.count(F.lit(1)).alias("games"))
    return counts.where("games >= 1000")


_IMPORTANCE = """(SELECT version, feature, sum(gain) AS gain FROM (SELECT CAST(season AS VARCHAR) AS version, feature, abs(contribution) AS gain FROM factors JOIN games USING (game_id)) GROUP BY 1, 2)"""


@query(
    "a12_importance",
    f"SELECT version, feature, gain/sum(gain) OVER (PARTITION BY version) AS share, row_number() OVER (PARTITION BY version ORDER BY round(gain, 6) DESC, feature) AS rank FROM {_IMPORTANCE}",
    "share",
)
def a12_importance(L: League) -> DataFrame:
    rows = L.predictions().join(L.games().select("game_id", "season"), "game_id")
    gains = rows.select(F.col("season").cast("string").alias("version"), F.explode("factors").alias("f"))
    summed = gains.groupBy("version", F.col("f.feature").alias("feature")).agg(
        F.round(F.sum(F.abs("f.contribution")), 6).alias("gain")
    )
    maps = summed.groupBy("version").agg(F.map_from_entries(F.collect_list(F.struct("feature", "gain"))).alias("importance"))
    return serving.importance_shares(maps)


@query(
    "a18_versus_baseline",
    f"SELECT season, m.logloss AS model_logloss, e.logloss AS elo_logloss, e.logloss - m.logloss AS gap, m.logloss < e.logloss AS won FROM (SELECT season, {_LOSS} AS logloss FROM {_VARIANTS} WHERE variant = 'model' GROUP BY 1) m JOIN (SELECT season, {_LOSS} AS logloss FROM {_VARIANTS} WHERE variant = 'elo' GROUP BY 1) e USING (season)",
    "model_logloss elo_logloss gap",
)
def a18_versus_baseline(L: League) -> DataFrame:
    return ev.versus_baseline(ev.season_and_pooled(variants(L)))


@query("a19_completed_seasons", "SELECT DISTINCT season FROM games WHERE status = 'final' AND season >= 1996 AND season < 2000")
def a19_completed_seasons(L: League) -> DataFrame:
    season = TODAY.year - (TODAY.month < 8)
    return labelled(L.features(), 1996).where(F.col("season") < season).select("season").distinct()


@query(
    "m6_acceptance",
    f"""SELECT bool_and(m.logloss < e.logloss) AS beats_elo_logloss, bool_and(m.brier < e.brier) AS beats_elo_brier, any_value(c.ece) <= 0.03 AS calibrated FROM
        (SELECT * FROM ({_POOLED}) WHERE variant = 'model' AND season IN (SELECT DISTINCT season FROM {_LONG} ORDER BY season DESC LIMIT 2)) m
        JOIN (SELECT * FROM ({_POOLED}) WHERE variant = 'elo') e ON e.season = m.season CROSS JOIN (SELECT ece FROM ({_POOLED}) WHERE variant = 'model' AND season IS NULL) c""",
)
def m6_acceptance(L: League) -> DataFrame:
    return ev.acceptance(ev.season_and_pooled(variants(L)))


@query(
    "m11_evaluate",
    f"SELECT 'model' AS part, logloss, brier, accuracy, ece, n FROM ({_metrics_sql(_STATE_P, [])}) UNION ALL SELECT quarter, logloss, brier, accuracy, ece, n FROM ({_metrics_sql(_STATE_P, ['quarter'])}) WHERE quarter IS NOT NULL",
    _METRICS,
)
def m11_evaluate(L: League) -> DataFrame:
    rows = _ingame(L)
    parts = F.filter(F.array(F.lit("model"), F.col("quarter")), lambda x: x.isNotNull())
    return ev.metric_summary(rows.withColumn("part", F.explode(parts)), ["part"])


@query(
    "m14_promotion",
    f"""SELECT season, logloss, promote, reason FROM (SELECT season, logloss, CASE WHEN season % 3 = 0 THEN false WHEN season % 3 = 1 THEN true ELSE logloss < elo END AS promote,
        CASE WHEN season % 3 = 0 THEN 'failed acceptance: calibrated' WHEN season % 3 = 1 THEN 'production v7 was not evaluated on ' || season
          WHEN logloss < elo THEN 'log loss ' || printf('%.4f', logloss) || ' < production v7 ' || printf('%.4f', elo) ELSE 'log loss ' || printf('%.4f', logloss) || ' >= production v7 ' || printf('%.4f', elo) END AS reason
        FROM (SELECT season, m.logloss, e.logloss AS elo FROM (SELECT season, {_LOSS} AS logloss FROM {_VARIANTS} WHERE variant = 'model' GROUP BY 1) m JOIN (SELECT season, {_LOSS} AS logloss FROM {_VARIANTS} WHERE variant = 'elo' GROUP BY 1) e USING (season)))""",
    "logloss",
)
def m14_promotion(L: League) -> DataFrame:
    gaps = ev.versus_baseline(ev.season_and_pooled(variants(L)))
    kind = F.col("season") % 3
    candidates = gaps.select(
        F.concat(F.lit("m"), F.col("season").cast("string")).alias("name"),
        "season",
        F.col("model_logloss").alias("logloss"),
        F.when(kind == 0, F.array(F.lit("calibrated"))).otherwise(F.array().cast("array<string>")).alias("failed"),
    )
    tags = F.create_map(
        F.when(kind == 2, rules.season_tag(F.col("season"))).otherwise("other"), F.col("elo_logloss").cast("string")
    )
    production = gaps.select(F.concat(F.lit("m"), F.col("season").cast("string")).alias("name"), F.lit("7").alias("version"), tags.alias("tags"))
    return rules.promotion(candidates, production).select("season", "logloss", "promote", "reason")


@query(
    "m15_heldout_logloss",
    f"SELECT variant, logloss FROM (SELECT variant, season, {_LOSS} AS logloss FROM {_VARIANTS} GROUP BY 1, 2) WHERE season = (SELECT max(season) FROM {_LONG})",
    "logloss",
)
def m15_heldout_logloss(L: League) -> DataFrame:
    seasons = ev.metric_summary(variants(L), ["variant", "season"])
    # One tag per season of a version.
    tags = seasons.groupBy("variant").agg(
        F.map_from_entries(F.collect_list(F.struct(rules.season_tag(F.col("season")), F.col("logloss").cast("string")))).alias("tags")
    )
    return tags.select("variant", rules.heldout_logloss(F.col("tags")).alias("logloss"))


@query(
    "m16_version_snapshot",
    "SELECT DISTINCT model_version || '-' || (ok % 20) AS version FROM predictions WHERE model_version || '-' || (ok % 20) NOT IN (SELECT DISTINCT '7-' || (ok % 10) FROM games)",
)
def m16_version_snapshot(L: League) -> DataFrame:
    tail = F.floor(F.col("id") / 10) % 20
    used = L.predictions().select(F.concat_ws("-", "model_version", tail.cast("string")).alias("version")).distinct()
    stored = L.games().select(F.concat(F.lit("7-"), (F.col("ok") % 10).cast("string")).alias("version")).distinct()
    return rules.snapshot_versions(used, stored)


_FINISHED = "(SELECT game_id, game_date, season, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS y FROM games WHERE status = 'final')"
_PRE = f"""(SELECT 'pregame' AS model, game_id, game_date, model_version, home_win_prob AS p, y FROM
    (SELECT p.*, f.game_date, f.y, row_number() OVER (PARTITION BY p.game_id ORDER BY created_at DESC, id DESC) AS rn FROM predictions p JOIN {_FINISHED} f USING (game_id) WHERE made_before_tip AND season = {{season}}) WHERE rn = 1)"""
_IN = f"(SELECT 'ingame' AS model, game_id, game_date, model_version, home_win_prob AS p, y FROM snaps JOIN {_FINISHED} f USING (game_id) WHERE source = 'live' AND season = {{season}})"


@query("j20_pregame_rows", f"SELECT game_id, model_version, p AS home_win_prob, y AS home_win FROM {_PRE.format(season=2000)}", "home_win_prob")
def j20_pregame_rows(L: League) -> DataFrame:
    return monitor.pregame_rows(L.predictions(), L.games(), 2000).select("game_id", "model_version", "home_win_prob", "home_win")


@query("j20_ingame_rows", f"SELECT game_id, model_version, p AS home_win_prob, y AS home_win FROM {_IN.format(season=1994)}", "home_win_prob")
def j20_ingame_rows(L: League) -> DataFrame:
    return monitor.ingame_rows(L.snapshots(), L.games(), 1994).select("game_id", "model_version", "home_win_prob", "home_win")


def _monitor_sql(season: int, since30: str) -> str:
    rows = f"(SELECT * FROM {_PRE.format(season=season)} UNION ALL SELECT * FROM {_IN.format(season=season)})"
    win = f"(SELECT 'season' AS win, * FROM {rows} WHERE game_date >= DATE '{season}-08-01' UNION ALL SELECT 'last_30_days', * FROM {rows} WHERE game_date >= DATE '{since30}')"
    kinds = "(SELECT * FROM (VALUES ('pregame', 50, 0.03::DOUBLE), ('ingame', 20, 0.05::DOUBLE)) a(model, needed, tol), (VALUES ('season'), ('last_30_days')) b(win))"
    freq = f"(SELECT model, win, min(model_version) AS version FROM (SELECT *, max(c) OVER (PARTITION BY model, win) AS mc FROM (SELECT model, win, model_version, count(*) AS c FROM {win} GROUP BY 1, 2, 3)) WHERE c = mc GROUP BY 1, 2)"
    return f"""SELECT model, win AS window, CASE WHEN enough THEN version END AS model_version, games,
        CASE WHEN enough THEN logloss END AS logloss, CASE WHEN enough THEN ece END AS ece, CASE WHEN enough THEN expected END AS expected_logloss,
        CASE WHEN NOT enough THEN 'insufficient' WHEN worse OR bad THEN 'warning' ELSE 'ok' END AS status,
        CASE WHEN NOT enough THEN games || ' finished games with predictions; at least ' || needed || ' are needed.'
          ELSE CASE WHEN worse THEN 'Worse than expected: ' ELSE '' END || 'Log loss ' || printf('%.3f', logloss) || ' over ' || games || ' games'
            || CASE WHEN expected IS NOT NULL THEN ', expected about ' || printf('%.3f', expected) || '.' ELSE '; no held-out log loss to compare with.' END
            || CASE WHEN bad THEN ' Calibration error ' || printf('%.1f', ece*100) || '% is above 6%.' ELSE '' END END AS message
        FROM (SELECT *, games >= needed AS enough, coalesce(logloss > expected + tol, false) AS worse, games >= 200 AND ece > 0.06 AS bad FROM
         (SELECT k.*, coalesce(g.games, 0) AS games, m.logloss, m.ece, v.version, CASE v.version WHEN '7' THEN 0.65::DOUBLE WHEN '4' THEN 0.6::DOUBLE END AS expected FROM {kinds} k
          LEFT JOIN (SELECT model, win, count(DISTINCT game_id) AS games FROM {win} GROUP BY 1, 2) g USING (model, win)
          LEFT JOIN ({_metrics_sql(win, ['model', 'win'])}) m USING (model, win) LEFT JOIN {freq} v USING (model, win)))"""


def _monitored(L: League, today: date) -> DataFrame:
    expected = L.spark.createDataFrame(
        [("pregame", "7", 0.65), ("ingame", "4", 0.6)], "model string, model_version string, logloss double"
    )
    out = monitor.run_monitor(L.predictions(), L.snapshots(), L.games(), expected, today)
    return out.drop("brier", "accuracy")


@query("m18_judge", _monitor_sql(2000, "2001-04-20"), "logloss ece expected_logloss")
def m18_judge(L: League) -> DataFrame:
    """A day when only the pre-game model has enough finished games."""
    return _monitored(L, TODAY)


@query("m19_monitor", _monitor_sql(1994, "1995-01-21"), "logloss ece expected_logloss")
def m19_monitor(L: League) -> DataFrame:
    """A day when both models have finished games in both windows."""
    return _monitored(L, date(1995, 2, 20))


@query(
    "m21_report",
    f"""SELECT season, rpad(coalesce(CAST(season AS VARCHAR), 'pooled'), 7, ' ') || '  ' || printf('%.4f', m.logloss) || ' (' || printf('%.4f', e.logloss) || ')   ' || printf('%.4f', m.brier) || ' (' || printf('%.4f', e.brier)
        || ')   ' || printf('%.3f', m.accuracy) || ' (' || printf('%.3f', e.accuracy) || ')    ' || printf('%.3f', m.ece) AS line
        FROM (SELECT * FROM ({_POOLED}) WHERE variant = 'model') m JOIN (SELECT season AS s2, logloss, brier, accuracy FROM ({_POOLED}) WHERE variant = 'elo') e ON e.s2 IS NOT DISTINCT FROM m.season""",
)
def m21_report(L: League) -> DataFrame:
    return rules.report_lines(ev.season_and_pooled(variants(L)))


@query(
    "p23_training_inputs",
    """SELECT s.game_id, s.action_id, (score_home - score_away) / sqrt(seconds_remaining + 1) AS x_diff_per_sqrt_time, ln(q/(1-q))*seconds_remaining/2880 AS x_pregame_logit_x_time
       FROM (SELECT *, (user_id % 97 + 1)/98.0::DOUBLE AS q FROM states) s""",
    "x_diff_per_sqrt_time x_pregame_logit_x_time",
)
def p23_training_inputs(L: League) -> DataFrame:
    users = L.events().select("game_id", "user_id").distinct()
    rows = L.states().join(users, "game_id").withColumn("pregame_prob", (F.col("user_id") % 97 + 1) / 98.0)
    return with_inputs(rows).select("game_id", "action_id", "x_diff_per_sqrt_time", "x_pregame_logit_x_time")
