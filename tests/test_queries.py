"""A sample of the registered queries against DuckDB on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = entry.SMOKE_DIR
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["icp_by_region", "quality_all_suppliers", "cooccurrence_view", "cosine_row_sums", "class_relation_scores", "term_removal", "rule_anti_join", "lexical_documents", "instantiation_closed", "mutual_best_match"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in duck.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
