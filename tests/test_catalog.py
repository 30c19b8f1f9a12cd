"""Every registered query against its SQL statement in another engine, and its physical plan."""

import os
import re

import duckdb
import pytest

from boutline.catalog import ORACLES, QUERIES, feeds
from tests.conftest import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(cell(row[i]) for i in at) for row in result.fetchall())
    assert ours == theirs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["w13_game_features", "team_form", "w8_possession", "u3_tip_off", "w10_thinning", "j7_lateral_latest", "a7_by_season_and_pooled"]
)
def test_plans_scale(spark, name):
    """No cross join, and no window over the whole table in one task."""
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if re.search(r"\bWindow \[", line):
            assert "windowspecdefinition(" in line
    assert "SinglePartition" not in text


def test_team_windows_share_one_shuffle(spark):
    text = plan(QUERIES["team_form"](spark, SF))
    by_team = [line for line in text.splitlines() if "Exchange hashpartitioning(team_id" in line]
    assert len(by_team) == 1 and "REPARTITION_BY_NUM" in by_team[0]
    upper = text.split(by_team[0])[0]
    assert len(re.findall(r"\bSort \[", upper)) == 2


def test_scans_read_only_what_is_used(spark):
    text = plan(QUERIES["p3_season_of_date"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    text = plan(QUERIES["a13_last_action"](spark, SF))
    assert re.search(r"ReadSchema: struct<game_id:string,source:string,action_id:bigint>", text)
    text = plan(QUERIES["j8_target_games"](spark, SF))
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(game_date" in text


def test_summaries_are_gathered_as_numbers_and_land_compressed(spark, monkeypatch, tmp_path):
    """Text made before the sort by game is sorted and spilled; a gzip file is read by one task, so it is cut."""
    gathered, land = [], feeds._landed

    def landed(L, name, rows, schema):
        gathered.extend(line for line in plan(rows).splitlines() if "collect_list" in line)
        return land(L, name, rows, schema)

    monkeypatch.setattr(feeds, "_landed", landed)
    monkeypatch.setattr(feeds, "FILE_DOCUMENTS", 100)
    monkeypatch.setattr(feeds, "fresh_path", lambda _, name: f"{tmp_path}/{name}")
    assert QUERIES["s5_summary_box"](spark, SF).count() > 2000
    assert gathered and not any("displayValue" in line for line in gathered)
    files = [f for f in os.listdir(tmp_path / "landing/s5") if f.startswith("part-")]
    assert len(files) >= 10 and all(f.endswith(".gz") for f in files)


def test_factors_meet_names_before_they_are_exploded(spark):
    text = plan(QUERIES["p26_feature_label"](spark, SF))
    assert 0 < text.index("posexplode") < text.index("Join")


def test_worker_functions_travel_by_value():
    import pickle

    from pyspark import cloudpickle

    from boutline.operators.ratings import _fold_pools

    blob = cloudpickle.dumps(_fold_pools)
    assert b"boutline.operators" not in blob or pickle.loads(blob).__code__.co_code == _fold_pools.__code__.co_code


def test_queries_run_with_code_that_the_jvm_compiles(spark):
    """A log's cells are read by a method of more than 8,000 bytes, which the JVM would interpret for good."""
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, "65535")
    rows = QUERIES["s1_game_log_box"](spark, SF)
    assert int(spark.conf.get(key)) <= 8000
    assert rows.count() > 0
