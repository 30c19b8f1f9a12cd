"""Registered queries against their SQL, and what every operator does with odd tables."""

import duckdb
import pytest

import corpus_pipeline
from boutline.llm import decontaminate, jaccard, language, licenses, mixing, pii, quality, secrets, substrings, tokens
from boutline.llm.queries import ORACLES, QUERIES

from .conftest import SF


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    found = con.sql(ORACLES[name])
    order = [found.columns.index(c) for c in sorted(got.columns)]
    assert sorted(found.columns) == sorted(got.columns)
    assert rows_of(got) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "secrets", "mix"]


@pytest.fixture(scope="module")
def operators(spark):
    import public_tokenizers

    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    items = [(1, "sat on the mat and then it sat on the mat again"), (2, None), (3, ""), (None, "una casa en la calle"), (1, "una casa")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {
        "quality": lambda d: quality.quality_rules(d, labels),
        "jaccard": lambda d: jaccard.jaccard_join(d, 3, 90),
        "language": language.identify,
        "decontaminate": lambda d: decontaminate.contamination(d, benchmark),
        "pii": lambda d: pii.pii_digest(pii.find_pii(d)),
        "secrets": lambda d: secrets.secrets_digest(secrets.find_secrets(d)),
        "tokens": lambda d: tokens.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
        "licenses": licenses.scan_licenses,
        "substrings": substrings.remove_repeats,
        "mixing": mixing.mix_report,
    }


NAMES = ["quality", "jaccard", "language", "decontaminate", "pii", "secrets", "tokens", "licenses", "substrings", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_give_one_row_each(operators, odd, name):
    got = operators[name](odd).collect()
    ids = [r.doc_id for r in got]
    assert sorted(ids, key=str) == sorted([1, 1, 2, 3, 4, 5, 6, 6, None, None, 7], key=str)
    ones = [r for r in got if r.doc_id == 1]
    assert ones[0] == ones[1], "repeated rows have equal results"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(operators, none, name):
    assert operators[name](none).collect() == []


def test_texts_without_content(operators, odd):
    by_id = {name: {r.doc_id: r for r in operators[name](odd).collect()} for name in ("tokens", "quality", "language", "jaccard")}
    for doc_id in (2, 3, 4):
        assert by_id["quality"][doc_id].n_words == 0 and by_id["quality"][doc_id].base_failed and not by_id["quality"][doc_id].kept
        assert by_id["language"][doc_id].lang_pred == "und" and by_id["language"][doc_id].score == 0
        assert by_id["jaccard"][doc_id].n_shingles == 0 and by_id["jaccard"][doc_id].component_id == doc_id
    assert by_id["tokens"][2].n_tokens == by_id["tokens"][3].n_tokens == 0
    assert by_id["language"][7].lang_pred == "und"
    assert by_id["jaccard"][None].component_id is None


def test_pipeline_stages_take_odd_rows(spark, odd, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "sat on the mat and then it sat on the mat again")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(kept["language"]) == {1, 5, 6, None}
    assert kept["near_copies"].count(1) == 1 and kept["near_copies"].count(6) == 2
    assert 1 not in kept["benchmark"]
    assert sorted(kept["secrets"], key=str) == sorted(kept["benchmark"], key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where(F.lit(False)), str(tmp_path)).collect() == []


def test_pipeline_runs_whole(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == docs.columns
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
