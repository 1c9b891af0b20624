import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.operators import joins
from brindle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def norm(v):
    return "~" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    res = duck.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    q = catalogue.QUERIES
    assert "SortMergeJoin" in plan(q["join_hint_merge"](spark, SF))
    assert "ShuffledHashJoin" in plan(q["join_hint_hash"](spark, SF))
    assert "BroadcastHashJoin" in plan(q["join_hint_broadcast"](spark, SF))
    assert "CartesianProduct" in plan(q["join_hint_nested_loop"](spark, SF))
    assert "LocalTableScan <empty>" in plan(q["constant_false"](spark, SF))
    assert "EqualTo(o_orderkey,7)" in plan(q["filter_point_lookup"](spark, SF))
    assert "TakeOrderedAndProject" in plan(q["order_limit_topk"](spark, SF))
    assert "LeftAnti" in plan(q["sub_not_exists"](spark, SF))


def test_tiled_join_spreads_a_key_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 50)
    monkeypatch.setattr(joins, "TASK_PAIRS", 5_000)
    left = spark.range(600).selectExpr("id as x", "if(id % 10 = 0, id % 7, if(id % 11 = 0, null, 1)) as k", "if(id % 13 = 0, null, id % 101) as v")
    right = spark.range(900).selectExpr("id as y", "if(id % 9 = 0, id % 8, 1) as l", "id % 97 as w")
    right = right.union(right.where("y < 100"))  # repeated rows are joined each
    got = joins.tiled(left, right, ("k", "l"), F.col("v") > F.col("w"))
    want = left.join(right, (left.k == right.l) & (left.v > right.w))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    tasks = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) > 40 and max(tasks) < sum(tasks) / 10
    assert not joins.tiled(left, right.where("y < 0"), ("k", "l"), F.col("v") > F.col("w")).collect()


def test_composite_join_has_tasks_for_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 2)
    monkeypatch.setattr(joins, "TASK_PAIRS", 5)
    df = catalogue.QUERIES["join_composite"](spark, SF)
    assert df.rdd.getNumPartitions() > 5  # a task a file before, whatever the pairs
