"""Every registered query outside the llm subpackage against its SQL in DuckDB, or for rows where there is none."""

import pytest
from conftest import rows_of

import __spark_entry__ as entry

QUERIES = {k: f for part in entry.CATALOGS for k, f in part.C.queries.items()}
SQL = {k: s for part in entry.CATALOGS for k, s in part.C.sql.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_d11_and_d12_match_every_source(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = part.where("p_partkey % 3 <> 0").selectExpr("p_brand", "substring_index(p_name, ' ', 1) AS first").distinct()
    met = part.selectExpr("p_partkey AS src_id", "p_brand", "substring_index(p_name, ' ', 1) AS first").join(own, ["p_brand", "first"])
    want = {r.src_id for r in met.collect()}
    found = lambda name: {r.src_id for r in QUERIES[name](spark, sf_dir).select("src_id").collect()}
    assert found("d11_weighted_match") == want
    some = found("d12_token_set_matches")  # leaves out pairs that score too low
    assert some <= want and {k % 4 for k in some} == {0, 1, 2, 3}
