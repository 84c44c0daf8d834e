"""Every catalogue query against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, float):
        return repr(x)
    return str(x)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = con.execute(catalogue.ORACLES[name])
    cols = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, df.collect()) == rows(cols, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_ransac_finds_the_planted_transform(spark, sf_dir):
    got = catalogue.QUERIES["q35_ransac_similarity"](spark, sf_dir).where("accepted").collect()
    assert got and all(abs(r["a"] - 0.8) < 0.05 and abs(r["b"] - 0.3) < 0.05 for r in got)


def test_stages_in_a_row_take_every_strategy(spark, sf_dir):
    got = {r["strategy"]: r for r in catalogue.QUERIES["q42_metadata_to_query"](spark, sf_dir).groupBy("strategy").agg({"*": "count", "record_id": "max"}).collect()}
    assert set(got) == {"strategy_a", "strategy_b", "strategy_c"} and all(r["max(record_id)"] >= 0 for r in got.values())
