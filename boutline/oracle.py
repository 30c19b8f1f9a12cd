"""The fixture league as ANSI SQL: an independent statement of every view, for checking.

Where the Spark side uses a running carry, this side uses another route on purpose (as-of
joins, recursive folds, islands, self-joins)."""

from __future__ import annotations

import re

OWN = ["pts", "minutes", "fgm", "fg3m", "fga", "fta", "ftm", "tov", "oreb", "dreb"]
OPP = [c for c in OWN if c != "minutes"]
COMPONENTS = OWN + [f"opp_{c}" for c in OPP]


def rates_sql(p: str = "") -> dict[str, str]:
    c = {name: f"{p}{name}" for name in COMPONENTS}
    poss = (
        f"(({c['fga']}+{c['opp_fga']}-{c['oreb']}-{c['opp_oreb']}+{c['tov']}+{c['opp_tov']}"
        f"+0.44::DOUBLE*({c['fta']}+{c['opp_fta']}))/2)"
    )
    return {
        "ortg": f"100*{c['pts']}/nullif({poss},0)",
        "drtg": f"100*{c['opp_pts']}/nullif({poss},0)",
        "net": f"100*{c['pts']}/nullif({poss},0)-100*{c['opp_pts']}/nullif({poss},0)",
        "pace": f"240*{poss}/nullif({c['minutes']},0)",
        "efg": f"({c['fgm']}+0.5::DOUBLE*{c['fg3m']})/nullif({c['fga']},0)",
        "tov_pct": f"{c['tov']}/nullif({c['fga']}+0.44::DOUBLE*{c['fta']}+{c['tov']},0)",
        "orb_pct": f"{c['oreb']}::DOUBLE/nullif({c['oreb']}+{c['opp_dreb']},0)",
        "ftr": f"{c['ftm']}::DOUBLE/nullif({c['fga']},0)",
        "opp_efg": f"({c['opp_fgm']}+0.5::DOUBLE*{c['opp_fg3m']})/nullif({c['opp_fga']},0)",
        "opp_tov_pct": f"{c['opp_tov']}/nullif({c['opp_fga']}+0.44::DOUBLE*{c['opp_fta']}+{c['opp_tov']},0)",
        "drb_pct": f"{c['dreb']}::DOUBLE/nullif({c['dreb']}+{c['opp_oreb']},0)",
        "opp_ftr": f"{c['opp_ftm']}::DOUBLE/nullif({c['opp_fga']},0)",
    }


def eastern_sql(ts: str) -> str:
    """Local time of the league: summer time from the second Sunday of March to the first of
    November, at two o'clock."""
    march, november = f"make_date(year({ts}), 3, 1)", f"make_date(year({ts}), 11, 1)"
    start = f"CAST({march} + 7 + CAST((7 - dayofweek({march})) % 7 AS INTEGER) AS TIMESTAMP) + to_hours(7)"
    end = f"CAST({november} + CAST((7 - dayofweek({november})) % 7 AS INTEGER) AS TIMESTAMP) + to_hours(6)"
    return f"({ts} - to_hours(CASE WHEN {ts} >= {start} AND {ts} < {end} THEN 4 ELSE 5 END))"


STD = ["ortg", "drtg", "net", "pace", "efg", "tov_pct", "orb_pct", "ftr", "opp_efg", "opp_tov_pct", "drb_pct", "opp_ftr"]
STATE = (
    ["games_played", "win_pct", "streak"]
    + [f"std_{r}" for r in STD]
    + [f"l10_{r}" for r in ("ortg", "drtg", "net", "efg", "opp_efg")]
    + ["l5_net"]
)
PER_TEAM = [*STATE, "prev_net", "rest_days", "b2b", "games_last7", "travel_km"]
DIFFS = [
    "elo_pre", "win_pct", "std_net", "l10_net", "l5_net", "prev_net", "rest_days",
    "std_efg", "std_opp_efg", "travel_km",
]


def _state_rates(kind: str) -> str:
    wanted = {"std": STD, "l10": ["ortg", "drtg", "net", "efg", "opp_efg"], "l5": ["net"]}[kind]
    r = rates_sql(f"{kind}_")
    return ", ".join(f"{r[w]} AS {kind}_{w}" for w in wanted)


def _side(t: str, side: int) -> str:
    x = f"(coalesce(q.q,0)*7 + k.ok*31 + k.{t}*101)"
    return f"""
        CASE WHEN k.ok % 16 = 0 THEN 265 ELSE 240 END AS {t}_minutes,
        32 + ({x}*3)%16 + (k.{t}*7)%11 - 5 + {side} AS {t}_fgm, 75 + {x}%20 AS {t}_fga,
        8 + ({x}*7)%10 AS {t}_fg3m, 25 + ({x}*5)%15 AS {t}_fg3a, 10 + ({x}*13)%5 AS {t}_ftm0,
        15 + ({x}*11)%15 AS {t}_fta, 6 + ({x}*17)%9 AS {t}_oreb, 28 + ({x}*19)%12 AS {t}_dreb,
        8 + ({x}*23)%10 AS {t}_tov"""


def _stat(s: str, o: str, home: str) -> str:
    cols = ", ".join(f"{s}_{c} AS {c}" for c in [*OWN, "fg3a"])
    return f"SELECT gid AS game_id, {s} AS team_id, {home} AS is_home, {cols}, {s}_pts - {o}_pts AS plus_minus FROM fx_sides WHERE q IS NOT NULL"


def _tg(own: str, other: str) -> str:
    return f"""SELECT game_id, season, game_date, status, site_lat, site_lon, {own}_team_id AS team_id,
        {other}_team_id AS opp_id, {own}_score AS score, {other}_score AS opp_score, {str(own == 'home').lower()} AS is_home
        FROM prepared"""


_PRE = """CASE WHEN s[{t}+1] IS NULL THEN 1500.0::DOUBLE WHEN s[{t}+1] <> g.season
          THEN 0.75::DOUBLE*r[{t}+1] + 0.25::DOUBLE*1505 ELSE r[{t}+1] END"""

CTES: dict[str, str] = {
    "fx_ring": """SELECT CAST(c_custkey AS BIGINT) AS team, CAST(c_nationkey AS BIGINT) AS nation,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rank, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer""",
    "fx_rounds": """SELECT ok, cust, priority, stretch, row_number() OVER (PARTITION BY cust, stretch ORDER BY ok) - 1 AS k FROM
        (SELECT o_orderkey AS ok, o_custkey AS cust, o_orderpriority AS priority,
         date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 30 AS stretch FROM orders)""",
    "fx_placed": """SELECT *, 1 + (stretch + k) % (size // 2) AS step FROM fx_rounds JOIN fx_ring ON cust = team""",
    "fx_kept": """SELECT p.ok, p.priority, p.team AS h, o.team AS a, p.nation AS pool,
        DATE '1992-01-01' + CAST(stretch*30 + k*3 + CASE WHEN p.rank >= p.size - step THEN 2 ELSE (p.rank // step) % 2 END AS INTEGER) AS d
        FROM fx_placed p JOIN fx_ring o ON o.nation = p.nation AND o.rank = (p.rank + step) % p.size""",
    "fx_q": "SELECT l_orderkey AS ok, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1",
    "fx_lines": f"SELECT k.*, q.q, {_side('h', 1)}, {_side('a', 0)} FROM fx_kept k LEFT JOIN fx_q q ON k.ok = q.ok",
    "fx_sides": """SELECT * EXCLUDE (tie), h_ftm0 + tie AS h_ftm, a_ftm0 AS a_ftm,
        2*h_fgm + h_fg3m + h_ftm0 + tie AS h_pts, 2*a_fgm + a_fg3m + a_ftm0 AS a_pts,
        lpad(CAST(ok AS VARCHAR), 10, '0') AS gid FROM
        (SELECT *, CASE WHEN 2*h_fgm + h_fg3m + h_ftm0 = 2*a_fgm + a_fg3m + a_ftm0 THEN 1 ELSE 0 END AS tie FROM fx_lines)""",
    "games": """SELECT game_id, ok, season, season_type, game_date, tip_time_utc, home_team_id, away_team_id, status,
        CASE WHEN status <> 'scheduled' THEN h_pts END AS home_score, CASE WHEN status <> 'scheduled' THEN a_pts END AS away_score,
        is_neutral, provider_id, pool FROM
        (SELECT gid AS game_id, ok, CAST(year(d) - CASE WHEN month(d) < 8 THEN 1 ELSE 0 END AS BIGINT) AS season,
         CASE priority WHEN '1-URGENT' THEN 'playoffs' WHEN '2-HIGH' THEN 'playin' ELSE 'regular' END AS season_type,
         d AS game_date, CASE WHEN ok % 17 <> 0 THEN CAST(d AS TIMESTAMP) + to_hours(22 + ok % 5) END AS tip_time_utc,
         h AS home_team_id, a AS away_team_id,
         CASE WHEN d >= DATE '2001-06-01' OR ok % 40 = 0 THEN 'scheduled' WHEN d >= DATE '2001-05-25' THEN 'live' ELSE 'final' END AS status,
         h_pts, a_pts, pool, CASE WHEN ok % 7 <> 0 THEN ok % 50 = 0 END AS is_neutral,
         CASE WHEN ok % 3 <> 0 THEN 'e' || CAST(ok AS VARCHAR) END AS provider_id FROM fx_sides)""",
    "stats": f"{_stat('h', 'a', 'true')} UNION ALL {_stat('a', 'h', 'false')}",
    "teams": """SELECT CAST(c_custkey AS BIGINT) AS team_id, 'C' || CAST(c_custkey AS VARCHAR) AS abbreviation, c_name AS full_name FROM customer""",
    "arenas": "SELECT team_id, CAST(25 + team_id % 25 AS DOUBLE) AS lat, CAST(-120 + 2*(team_id % 25) AS DOUBLE) AS lon FROM teams",
    "relocations": "SELECT team_id, 1996 AS season, 47.6::DOUBLE AS lat, -122.4::DOUBLE AS lon FROM teams WHERE team_id = 3",
    "prepared": """SELECT g.* EXCLUDE (is_neutral), coalesce(is_neutral, false) OR inside AS is_neutral,
        season_type = 'playoffs' AS is_playoffs,
        CASE WHEN inside THEN 28.5::DOUBLE ELSE coalesce(r.lat, a.lat) END AS site_lat,
        CASE WHEN inside THEN -81.4::DOUBLE ELSE coalesce(r.lon, a.lon) END AS site_lon
        FROM (SELECT *, season = 1999 AND game_date >= DATE '2000-07-01' AS inside FROM games) g
        LEFT JOIN relocations r ON r.team_id = g.home_team_id AND r.season = g.season
        LEFT JOIN arenas a ON a.team_id = g.home_team_id""",
    "box": "SELECT s.game_id, s.team_id, "
    + ", ".join(f"s.{c}" for c in OWN)
    + ", "
    + ", ".join(f"o.{c} AS opp_{c}" for c in OPP)
    + " FROM stats s JOIN stats o ON s.game_id = o.game_id AND s.team_id <> o.team_id",
    "tg": f"{_tg('home', 'away')} UNION ALL {_tg('away', 'home')}",
    "played": "SELECT tg.*, CASE WHEN score > opp_score THEN 1 ELSE 0 END AS win, box.* EXCLUDE (game_id, team_id) FROM tg JOIN box USING (game_id, team_id) WHERE status = 'final'",
    "sums": "SELECT game_id, team_id, season, game_date, win, row_number() OVER std AS games_played, CAST(sum(win) OVER std AS DOUBLE) / row_number() OVER std AS win_pct, "
    + ", ".join(f"CAST(sum({c}) OVER {w} AS BIGINT) AS {w}_{c}" for w in ("std", "l10", "l5") for c in COMPONENTS)
    + """ FROM played WINDOW std AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING),
        l10 AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS 9 PRECEDING),
        l5 AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS 4 PRECEDING)""",
    "islands": """SELECT *, games_played - row_number() OVER (PARTITION BY team_id, season, win ORDER BY game_date, game_id) AS island FROM sums""",
    "state": f"""SELECT game_id, team_id, season, game_date, CAST(games_played AS DOUBLE) AS games_played, win_pct,
        CAST((CASE WHEN win = 1 THEN 1 ELSE -1 END) * row_number() OVER (PARTITION BY team_id, season, win, island ORDER BY game_date, game_id) AS DOUBLE) AS streak,
        {_state_rates('std')}, {_state_rates('l10')}, {_state_rates('l5')} FROM islands""",
    "attached": "SELECT t.*, "
    + ", ".join(
        f"CASE WHEN s.season = t.season THEN s.{c} END AS {c}" if c != "games_played"
        else "CASE WHEN s.season = t.season THEN s.games_played ELSE 0.0::DOUBLE END AS games_played"
        for c in STATE
    )
    + " FROM tg t ASOF LEFT JOIN state s ON t.team_id = s.team_id AND t.game_date > s.game_date",
    "season_end": """SELECT team_id, season, std_net AS prev_net FROM
        (SELECT team_id, season, std_net, row_number() OVER (PARTITION BY team_id, season ORDER BY game_date DESC) AS rn FROM state WHERE std_net IS NOT NULL) WHERE rn = 1""",
    "prior": """SELECT *, lag(game_date) OVER w AS pd, lag(season) OVER w AS ps, lag(site_lat) OVER w AS pla, lag(site_lon) OVER w AS plo
        FROM tg WINDOW w AS (PARTITION BY team_id ORDER BY game_date, game_id)""",
    "load7": """SELECT t.game_id, t.team_id, CAST(count(e.game_id) AS DOUBLE) AS games_last7 FROM tg t LEFT JOIN tg e
        ON e.team_id = t.team_id AND e.game_date < t.game_date AND e.game_date >= t.game_date - 7 GROUP BY 1, 2""",
    "load": """SELECT p.game_id, p.team_id, games_last7,
        CAST(CASE WHEN ps = season THEN least(date_diff('day', pd, game_date), 7) ELSE 7 END AS DOUBLE) AS rest_days,
        CASE WHEN ps = season AND date_diff('day', pd, game_date) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b2b,
        CASE WHEN ps = season THEN 2*6371.0::DOUBLE*asin(sqrt(pow(sin((radians(site_lat)-radians(pla))/2),2)
          + cos(radians(pla))*cos(radians(site_lat))*pow(sin((radians(site_lon)-radians(plo))/2),2))) ELSE 0.0::DOUBLE END AS travel_km
        FROM prior p JOIN load7 l ON l.game_id = p.game_id AND l.team_id = p.team_id""",
    "team_features": f"""SELECT a.game_id, a.team_id, a.is_home, {', '.join(f'a.{c}' for c in STATE)}, e.prev_net,
        l.rest_days, l.b2b, l.games_last7, l.travel_km FROM attached a JOIN load l ON l.game_id = a.game_id AND l.team_id = a.team_id
        LEFT JOIN season_end e ON e.team_id = a.team_id AND e.season = a.season - 1""",
    "elo_order": """SELECT p.*, x.rank AS hi, y.rank AS ai, row_number() OVER (PARTITION BY p.pool ORDER BY game_date, game_id) AS i
        FROM prepared p JOIN fx_ring x ON x.team = p.home_team_id JOIN fx_ring y ON y.team = p.away_team_id""",
    "elo_fold": f"""SELECT nation AS pool, CAST(0 AS BIGINT) AS i, CAST([NULL for x in range(size)] AS DOUBLE[]) AS r, CAST([NULL for x in range(size)] AS BIGINT[]) AS s,
          CAST(NULL AS VARCHAR) AS game_id, CAST(NULL AS DOUBLE) AS home_elo_pre, CAST(NULL AS DOUBLE) AS away_elo_pre,
          CAST(NULL AS DOUBLE) AS home_elo_post, CAST(NULL AS DOUBLE) AS away_elo_post FROM (SELECT nation, max(size) AS size FROM fx_ring GROUP BY nation)
        UNION ALL
        SELECT pool, i, CASE WHEN shift IS NULL THEN r ELSE list_transform(r, lambda v, k: CASE WHEN k = h + 1 THEN hp + shift WHEN k = a + 1 THEN ap - shift ELSE v END) END,
          CASE WHEN shift IS NULL THEN s ELSE list_transform(s, lambda v, k: CASE WHEN k = h + 1 OR k = a + 1 THEN season ELSE v END) END,
          game_id, hp, ap, hp + shift, ap - shift FROM
        (SELECT *, CASE WHEN status = 'final' THEN 20.0::DOUBLE * pow(abs(m) + 3.0::DOUBLE, 0.8::DOUBLE)
            / (7.5::DOUBLE + 0.006::DOUBLE * CASE WHEN m > 0 THEN diff ELSE -diff END)
            * (CASE WHEN m > 0 THEN 1 ELSE 0 END - 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, -diff / 400))) END AS shift FROM
         (SELECT *, hp + CASE WHEN neutral THEN 0 ELSE 100 END - ap AS diff FROM
          (SELECT g.pool, g.i, f.r, f.s, g.game_id, g.season, g.status, g.is_neutral AS neutral, g.home_score - g.away_score AS m,
             g.hi AS h, g.ai AS a, {_PRE.format(t='g.hi')} AS hp, {_PRE.format(t='g.ai')} AS ap
           FROM elo_fold f JOIN elo_order g ON g.pool = f.pool AND g.i = f.i + 1)))""",
    "elo": "SELECT game_id, home_elo_pre, away_elo_pre, home_elo_post, away_elo_post FROM elo_fold WHERE i > 0",
    "ratings": """SELECT g.game_id, g.season, g.game_date, home_team_id AS team_id, home_elo_pre AS elo_pre, home_elo_post AS elo_post FROM games g JOIN elo USING (game_id)
        UNION ALL SELECT g.game_id, g.season, g.game_date, away_team_id, away_elo_pre, away_elo_post FROM games g JOIN elo USING (game_id)""",
    "features": "SELECT p.game_id, p.season, p.season_type, p.game_date, p.status, p.home_team_id, p.away_team_id, p.home_score, p.away_score, "
    + ", ".join(f"{x}.{c} AS {s}_{c}" for s, x in (("home", "h"), ("away", "a")) for c in PER_TEAM)
    + ", e.home_elo_pre, e.away_elo_pre, e.home_elo_post, e.away_elo_post, "
    + ", ".join(
        (f"h.{c} - a.{c} AS diff_{c}" if c != "elo_pre" else "e.home_elo_pre - e.away_elo_pre AS diff_elo_pre")
        for c in DIFFS
    )
    + """, CASE WHEN is_neutral THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_neutral, CASE WHEN is_playoffs THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_playoffs,
        CASE WHEN p.status = 'final' THEN CASE WHEN p.home_score > p.away_score THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS home_win
        FROM prepared p JOIN elo e USING (game_id) LEFT JOIN team_features h ON h.game_id = p.game_id AND h.is_home
        LEFT JOIN team_features a ON a.game_id = p.game_id AND NOT a.is_home""",
    "fx_users": "SELECT game_id, row_number() OVER (ORDER BY ok) - 1 AS user_id FROM games",
    "fx_events": """SELECT u.game_id, e.user_id, e.event_id, e.event_type, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
        row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS action_id, count(*) OVER (PARTITION BY e.user_id) AS n,
        CASE WHEN e.user_id % 10 = 0 THEN 5 ELSE 4 END AS periods FROM events e JOIN fx_users u ON u.user_id = e.user_id""",
    "fx_typed": """SELECT *, CASE event_type WHEN 'click' THEN 'Made Shot' WHEN 'view' THEN 'Missed Shot' WHEN 'purchase' THEN 'Rebound'
          WHEN 'signup' THEN CASE WHEN k % 4 = 0 THEN 'Turnover' ELSE 'Free Throw' END
          ELSE CASE k % 6 WHEN 0 THEN 'Jump Ball' WHEN 1 THEN 'Substitution' WHEN 2 THEN 'Timeout' WHEN 3 THEN 'period' WHEN 5 THEN 'Foul' END END AS action_type,
        CAST(1 + (periods * (action_id - 1)) // n AS INTEGER) AS period FROM fx_events""",
    "fx_located": """SELECT *, CASE WHEN event_id % 13 = 0 OR action_type IS NOT DISTINCT FROM 'period' THEN NULL WHEN event_id % 2 = 0 THEN 'h' ELSE 'v' END AS location,
        CASE WHEN action_type = 'Free Throw' THEN CASE k % 5 WHEN 0 THEN 'Free Throw 1 of 2' WHEN 1 THEN 'Free Throw 2 of 2' WHEN 2 THEN 'Free Throw Technical'
          WHEN 3 THEN 'Free Throw Flagrant 2 of 2' ELSE 'Free Throw Clear Path 1 of 1' END END AS sub_type,
        CASE WHEN k % 3 = 0 THEN 'MISS x' ELSE 'ok x' END AS description,
        CASE WHEN action_type = 'Made Shot' THEN 2 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END WHEN action_type = 'Free Throw' AND k % 3 <> 0 THEN 1 ELSE 0 END AS points,
        CASE WHEN period = 5 THEN 300 ELSE 720 END AS len FROM fx_typed""",
    "pbp": """SELECT game_id, user_id, event_id, action_id, k, action_type, location, sub_type, description, period, points,
        CAST(10*len - (periods*(action_id-1)*10*len // n) % (10*len) AS DOUBLE) / 10 AS clock_seconds,
        CAST(sum(CASE WHEN location = 'h' THEN points ELSE 0 END) OVER w AS BIGINT) AS score_home,
        CAST(sum(CASE WHEN location = 'v' THEN points ELSE 0 END) OVER w AS BIGINT) AS score_away
        FROM fx_located WINDOW w AS (PARTITION BY game_id ORDER BY action_id ROWS UNBOUNDED PRECEDING)""",
    "outcomes": """SELECT *, CASE WHEN action_type IN ('period', 'Jump Ball') THEN 0 WHEN sd IS NULL THEN NULL
          WHEN action_type IN ('Made Shot', 'Turnover') THEN -sd WHEN action_type = 'Missed Shot' THEN 0 WHEN action_type = 'Rebound' THEN sd
          WHEN action_type = 'Free Throw' THEN CASE WHEN sub_type LIKE '%Technical%' THEN NULL
            WHEN sub_type LIKE '%1 of 2%' OR sub_type NOT LIKE '% of %' THEN sd
            WHEN sub_type LIKE '%Flagrant%' OR sub_type LIKE '%Clear Path%' THEN sd
            WHEN description LIKE 'MISS%' THEN 0 ELSE -sd END END AS outcome FROM
        (SELECT *, CASE location WHEN 'h' THEN 1 WHEN 'v' THEN -1 END AS sd FROM pbp
         WHERE action_type IS NULL OR action_type NOT IN ('Substitution', 'Timeout', 'Instant Replay'))""",
    "states": """SELECT o.game_id, o.user_id, o.action_id, o.period, o.clock_seconds, o.score_home, o.score_away, coalesce(c.outcome, 0) AS possession, o.description,
        CASE WHEN o.period <= 4 THEN (4 - o.period)*720 + o.clock_seconds ELSE o.clock_seconds END AS seconds_remaining,
        CASE WHEN o.period <= 4 THEN o.period*720 - o.clock_seconds ELSE 2880 + (o.period-4)*300 - o.clock_seconds END AS elapsed_seconds
        FROM outcomes o ASOF LEFT JOIN (SELECT game_id, action_id, outcome FROM outcomes WHERE outcome IS NOT NULL) c
        ON c.game_id = o.game_id AND o.action_id >= c.action_id""",
    "predictions": """SELECT ok*10 + j AS id, game_id, CASE WHEN j < 2 THEN '7' ELSE '10' END AS model_version,
        ((ok*37 + j*211) % 97 + 1) / 98.0::DOUBLE AS home_win_prob, CAST(game_date AS TIMESTAMP) + to_hours(18 + 3*j) AS created_at,
        CAST(game_date AS TIMESTAMP) + to_hours(18 + 3*j) < coalesce(tip_time_utc, CAST(game_date AS TIMESTAMP) + to_hours(24)) AS made_before_tip, ok, j
        FROM (SELECT *, unnest(range(0, ok % 4 + 1)) AS j FROM games)""",
    "factors": """SELECT p.id, p.game_id, f.i, f.feature, CASE WHEN (ok + j + f.i) % 3 <> 0 THEN CAST((ok + f.i*7) % 50 AS DOUBLE) END AS value,
        ((ok*13 + j + f.i*29) % 41 - 20) / 10.0::DOUBLE AS contribution FROM predictions p,
        (VALUES (0, 'home_elo_pre'), (1, 'diff_std_net'), (2, 'away_rest_days')) f(i, feature)""",
    "snaps": """SELECT (user_id*1000000 + action_id)*2 + CASE WHEN source = 'replay' THEN 1 ELSE 0 END AS id, game_id, source,
        CASE WHEN user_id % 5 = 0 THEN '3' ELSE '4' END AS model_version, action_id, period, clock_seconds, elapsed_seconds, score_home, score_away, possession,
        round(1 / (1 + exp(-0.15::DOUBLE * (score_home - score_away))), 6) AS home_win_prob FROM
        (SELECT *, 'live' AS source FROM states WHERE user_id % 3 <> 0 UNION ALL SELECT *, 'replay' FROM states WHERE user_id % 2 = 0)""",
}

# Read once per fold step or by several views: computed once.
MATERIALISED = {"fx_ring", "fx_kept", "elo_order", "games", "prepared", "tg", "state", "pbp", "outcomes", "team_features", "elo"}
_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def with_views(sql: str) -> str:
    """Prefix `sql` with the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_NAMES.findall(text)):
            if name in seen or name in needed:
                continue
            visit(CTES[name], (*seen, name))
            needed.append(name)

    visit(sql, ())
    if not needed:
        return sql
    return "WITH RECURSIVE " + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n in MATERIALISED else ''}({CTES[n]})" for n in needed
    ) + "\n" + sql
