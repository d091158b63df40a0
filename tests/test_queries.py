"""Every registered query against its SQL in DuckDB, on the small tables."""

import collections
import decimal
import re

import duckdb
import pytest

import __spark_entry__
from shelfmark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = collections.Counter(tuple(plain(x) for x in r) for r in df.collect())
    sql = duck.sql(registry.ORACLE[name])
    assert set(sql.columns) == set(df.columns)
    at = [sql.columns.index(c) for c in df.columns]
    assert got == collections.Counter(tuple(plain(r[k]) for k in at) for r in sql.fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 48
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.ORACLE) == set(registry.QUERIES)


@pytest.mark.parametrize("name", ["nested_paths", "name_pairs", "overlap_pairs", "merge_candidates_gated", "filter_untagged", "tree_below"])
def test_no_comparison_of_all_pairs(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pushdown_and_pruning(spark):
    plan = registry.QUERIES["filter_by_value"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan




@pytest.mark.parametrize("name", ["merge_plan", "unmerge_plan"])
def test_files_are_shuffled_by_their_item_once(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("REPARTITION_BY_COL" in line and "item" in line for line in dealt)
    assert not any(re.search(r"hashpartitioning\(id#\d+L?, item#", line) for line in dealt)


def test_copy_passes_read_the_files_once(spark):
    plan = registry.QUERIES["copy_passes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
