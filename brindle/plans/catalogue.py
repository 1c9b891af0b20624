"""Registered queries over the driver's tables, each beside its DuckDB equivalent."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import aggregates, joins, ordering, violations
from brindle.plans.statements import execute, run_script
from brindle.plans.workspace import ConstraintError, Workspace
from brindle.session import shared_dir
from brindle.sources import csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return register


@query(
    """SELECT r.r_name, count(*) AS cnt FROM customer c
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY r.r_name"""
)
def join_inner_multi(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    """SELECT * FROM customer"""
)
def scan_star(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


@query(
    """SELECT c_name, c_mktsegment FROM customer"""
)
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_name", "c_mktsegment")


@query(
    """SELECT * FROM orders WHERE o_totalprice >= 10000 AND o_totalprice <= 400000 AND o_orderkey > 100
    AND o_custkey < 1000 AND o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'"""
)
def filter_compare_ops(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(
        (o.o_totalprice >= 10000) & (o.o_totalprice <= 400000) & (o.o_orderkey > 100)
        & (o.o_custkey < 1000) & (o.o_orderstatus != "F") & (o.o_orderpriority == "1-URGENT")
    )


@query(
    """SELECT * FROM customer WHERE (c_nationkey = 3 AND c_acctbal > 0) OR NOT (c_mktsegment <> 'HOUSEHOLD')"""
)
def filter_bool_logic(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where((c.c_nationkey == 3) & (c.c_acctbal > 0) | ~(c.c_mktsegment != "HOUSEHOLD"))


@query(
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2, 3)"""
)
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where(c.c_nationkey.isin(1, 2, 3)).select("c_custkey", "c_nationkey")


@query(
    """SELECT * FROM customer WHERE c_nationkey NOT IN (9, 10)"""
)
def filter_not_in_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where(~c.c_nationkey.isin(9, 10))


@query(
    """SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND event_type = 'click'"""
)
def filter_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where((e.ts > F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) & (e.event_type == "click")).select("event_id", "user_id")


@query(
    """SELECT c_custkey FROM customer WHERE c_nationkey <> 0"""
)
def filter_truthy(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.where(c.c_nationkey.cast("boolean")).select("c_custkey")


@query(
    """SELECT * FROM lineitem WHERE l_discount > l_tax AND l_quantity < l_linenumber"""
)
def filter_column_to_column(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.where((x.l_discount > x.l_tax) & (x.l_quantity < x.l_linenumber))


@query(
    """SELECT * FROM orders WHERE o_orderkey = 7"""
)
def filter_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(o.o_orderkey == 7)


@query(
    """SELECT * FROM orders WHERE 1 = 0 OR o_custkey = 3"""
)
def constant_folding(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where((F.lit(1) == 0) | (o.o_custkey == 3))


@query(
    """SELECT * FROM orders WHERE 1 = 0"""
)
def constant_false(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.lit(1) == 0)


@query(
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"""
)
def order_limit_topk(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    """SELECT c_name FROM (SELECT c_name, c_acctbal, c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20)"""
)
def order_unselected_key(spark: SparkSession, d: str) -> DataFrame:
    return ordering.top(table(spark, d, "customer"), 20, F.asc("c_acctbal"), F.asc("c_custkey")).select("c_name")


@query(
    """SELECT * FROM orders LIMIT 0"""
)
def limit_zero(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").limit(0)


@query(
    """SELECT DISTINCT o_orderpriority FROM orders"""
)
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderpriority").distinct()


@query(
    """SELECT DISTINCT o_orderstatus, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)"""
)
def limit_then_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ordering.limit_then_distinct(table(spark, d, "orders"), 3, F.asc("o_orderkey")).select("o_orderstatus", "o_orderpriority").distinct()


@query(
    """SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_totalprice) AS m FROM orders GROUP BY 1 ORDER BY m)"""
)
def distinct_ordered_by_other(spark: SparkSession, d: str) -> DataFrame:
    return ordering.distinct_ordered(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


@query(
    """SELECT n_name, s_name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey"""
)
def join_left(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 5000")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", "s_name")


@query(
    """SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_regionkey = 1) RIGHT JOIN supplier ON n_nationkey = s_nationkey"""
)
def join_right(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation").where("n_regionkey = 1"), table(spark, d, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "right").select("n_name", "s_name")


@query(
    """SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_regionkey = 1) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON n_nationkey = s_nationkey"""
)
def join_right_compat(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation").where("n_regionkey = 1"), table(spark, d, "supplier").where("s_acctbal > 5000")
    return joins.joined(n, s, n.n_nationkey == s.s_nationkey, "right", "compat").select("n_name", "s_name")


@query(
    """SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 2000) ON n_nationkey = s_nationkey"""
)
def join_full(spark: SparkSession, d: str) -> DataFrame:
    n, s = table(spark, d, "nation").where("n_regionkey < 3"), table(spark, d, "supplier").where("s_acctbal > 2000")
    return n.join(s, n.n_nationkey == s.s_nationkey, "full").select("n_name", "s_name")


@query(
    """SELECT r_name, s_name FROM region CROSS JOIN supplier"""
)
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").crossJoin(table(spark, d, "supplier")).select("r_name", "s_name")


@query(
    """SELECT s.s_suppkey AS s_s_suppkey, s.s_name AS s_s_name, s.s_nationkey AS s_s_nationkey, s.s_acctbal AS s_s_acctbal,
    n.n_nationkey AS n_n_nationkey, n.n_name AS n_n_name, n.n_regionkey AS n_n_regionkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey"""
)
def join_star(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return joins.join_star(s, n, ("s", "n"), F.col("s.s_nationkey") == F.col("n.n_nationkey"))


@query(
    """SELECT r_name, s_name FROM region JOIN supplier ON r_regionkey < s_nationkey"""
)
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    r, s = table(spark, d, "region"), table(spark, d, "supplier")
    return r.join(s, r.r_regionkey < s.s_nationkey).select("r_name", "s_name")


@query(
    """SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal"""
)
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return joins.tiled(s, c, ("s_nationkey", "c_nationkey"), F.col("s_acctbal") > F.col("c_acctbal")).select("s_suppkey", "c_custkey")


@query(
    """SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey"""
)
def join_self_alias(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").alias("a"), table(spark, d, "orders").alias("b")
    same = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, same).select(F.col("a.o_orderkey").alias("a_key"), F.col("b.o_orderkey").alias("b_key"))


@query(
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def join_hint_merge(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return joins.hinted(c, n, c.c_nationkey == n.n_nationkey, "merge").select("c_custkey", "n_name")


@query(
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def join_hint_hash(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return joins.hinted(c, n, c.c_nationkey == n.n_nationkey, "hash").select("c_custkey", "n_name")


@query(
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def join_hint_broadcast(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return joins.hinted(c, n, c.c_nationkey == n.n_nationkey, "broadcast").select("c_custkey", "n_name")


@query(
    """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def join_hint_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return joins.hinted(c, n, c.c_nationkey == n.n_nationkey, "nested_loop").select("c_custkey", "n_name")


@query(
    """SELECT c_custkey, n_name FROM (SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS k FROM customer) c
    JOIN (SELECT n_name, CASE WHEN n_regionkey > 1 THEN n_nationkey END AS k FROM nation) n ON c.k IS NOT DISTINCT FROM n.k"""
)
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("k"))
    n = table(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") > 1, F.col("n_nationkey")).alias("k"))
    return c.join(n, c.k.eqNullSafe(n.k)).select("c_custkey", "n_name")


@query(
    """SELECT o_orderpriority, count(*) AS cnt, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate > TIMESTAMP '1995-01-01' GROUP BY o_orderpriority"""
)
def join_large(spark: SparkSession, d: str) -> DataFrame:
    x, o = table(spark, d, "lineitem").where("l_shipdate > timestamp_ntz'1995-01-01 00:00:00'"), table(spark, d, "orders")
    joined = x.join(o, x.l_orderkey == o.o_orderkey)
    return joined.groupBy("o_orderpriority").agg(aggregates.count().alias("cnt"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(
    """SELECT count(*) AS cnt, count(value) AS cnt_value, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events"""
)
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(
        aggregates.count().alias("cnt"), aggregates.count("value").alias("cnt_value"), F.round(aggregates.total("value"), 2).alias("total"),
        F.round(aggregates.average("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
    )


@query(
    """SELECT count(*) AS cnt, sum(value) AS total, avg(value) AS mean, min(value) AS low FROM events WHERE 1 = 0"""
)
def agg_empty_input(spark: SparkSession, d: str) -> DataFrame:
    none = table(spark, d, "events").where(F.lit(1) == 0)
    return none.agg(aggregates.count().alias("cnt"), aggregates.total("value").alias("total"), aggregates.average("value").alias("mean"), F.min("value").alias("low"))


@query(
    """SELECT count(*) AS cnt, coalesce(sum(value), 0) AS total, coalesce(avg(value), 0) AS mean FROM events WHERE 1 = 0"""
)
def agg_empty_compat(spark: SparkSession, d: str) -> DataFrame:
    none, how = table(spark, d, "events").where(F.lit(1) == 0), "compat"
    return none.agg(aggregates.count().alias("cnt"), aggregates.total("value", how).alias("total"), aggregates.average("value", how).alias("mean"))


@query(
    """SELECT c_nationkey, count(*) AS cnt FROM customer GROUP BY c_nationkey HAVING count(*) >= 60 AND avg(c_acctbal) > 0 ORDER BY cnt DESC"""
)
def agg_group_having_order(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "customer").groupBy("c_nationkey").agg(aggregates.count().alias("cnt"), F.avg("c_acctbal").alias("mean"))
    return grouped.where("cnt >= 60 and mean > 0").orderBy(F.desc("cnt")).drop("mean")


@query(
    """SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY sum(c_acctbal) DESC"""
)
def agg_order_by_unselected(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("total"))
    return grouped.orderBy(F.desc("total")).select("c_mktsegment")


@query(
    """SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"""
)
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(aggregates.count_distinct("user_id").alias("users"))


@query(
    """SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS cnt FROM orders"""
)
def agg_count_distinct_multi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(aggregates.count_distinct("o_custkey", "o_orderstatus").alias("cnt"))


@query(
    """SELECT count(DISTINCT coalesce(CAST(CASE WHEN o_custkey > 100 THEN o_custkey END AS VARCHAR), '')) AS cnt FROM orders"""
)
def agg_count_distinct_compat(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "orders").select(F.when(F.col("o_custkey") > 100, F.col("o_custkey")).alias("k"))
    return k.agg(aggregates.count_distinct("k", semantics="compat").alias("cnt"))


@query(
    """SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority"""
)
def agg_group_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query(
    """SELECT c_nationkey, arg_min(c_name, c_custkey) AS first_name, count(*) AS cnt FROM customer GROUP BY c_nationkey"""
)
def agg_exemplar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(aggregates.exemplar("c_name", "c_custkey").alias("first_name"), aggregates.count().alias("cnt"))


@query(
    """SELECT n_name, round(sum(c_acctbal), 2) AS total, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def agg_over_join(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    grouped = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name")
    return grouped.agg(F.round(F.sum("c_acctbal"), 2).alias("total"), aggregates.count().alias("cnt"))


@query(
    """SELECT c_mktsegment, min(c_name) AS low, max(c_name) AS high FROM customer GROUP BY c_mktsegment"""
)
def agg_min_max_string(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.min("c_name").alias("low"), F.max("c_name").alias("high"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc_price, round(avg(l_quantity), 6) AS avg_qty, count(*) AS cnt
    FROM lineitem GROUP BY l_returnflag, l_linestatus"""
)
def agg_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return grouped.agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), aggregates.count().alias("cnt"),
    )


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"""
)
def sub_in(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    return joins.exists_in(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"""
)
def sub_not_in(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 100000")
    return joins.not_exists_in(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query(
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')"""
)
def sub_exists(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'")
    return joins.exists_in(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query(
    """SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)"""
)
def sub_not_exists(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000")
    return joins.not_exists_in(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query(
    """SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey
    AND s.s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49))"""
)
def sub_nested(spark: SparkSession, d: str) -> DataFrame:
    n, s, x = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "lineitem").where("l_quantity > 49")
    busy = joins.exists_in(s, x, s.s_suppkey == x.l_suppkey)
    return joins.exists_in(n, busy, n.n_nationkey == busy.s_nationkey).select("n_name")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"


def filled(spark: SparkSession, d: str, *changes: str) -> Workspace:
    """A new workspace in the shared folder with the suppliers as a table, after the changes (SQL text)."""
    ws = Workspace(spark, fresh_path(spark, "workspace"))
    execute(ws, "CREATE TABLE s (s_suppkey INT PRIMARY KEY, s_name VARCHAR(40) NOT NULL, s_nationkey INT CHECK (s_nationkey >= 0), s_acctbal DOUBLE)")
    ws.insert("s", table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    for change in changes:
        execute(ws, change)
    return ws


def changed(spark: SparkSession, d: str, *changes: str) -> DataFrame:
    return filled(spark, d, *changes).table("s")


def refused(ws: Workspace, *changes: str) -> int:
    """How many of the changes break a constraint."""
    n = 0
    for change in changes:
        with contextlib.suppress(ConstraintError):
            execute(ws, change)
            continue
        n += 1
    return n


_SUPPLIER = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal"


@query(
    f"""{_SUPPLIER.replace("s_name", "CASE WHEN s_acctbal < 0 THEN 'renamed' ELSE s_name END AS s_name")} FROM supplier"""
)
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d, "UPDATE s SET s_name = 'renamed' WHERE s_acctbal < 0")


@query(
    f"""{_SUPPLIER} FROM supplier WHERE s_nationkey <> 1"""
)
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d, "DELETE FROM s WHERE s_nationkey = 1")


@query(
    f"""{_SUPPLIER} FROM supplier UNION ALL SELECT -1, 'ATLANTIS', 3, NULL UNION ALL SELECT -2, 'LEMURIA', 4, 2.5"""
)
def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d, "INSERT INTO s (s_suppkey, s_name, s_nationkey) VALUES (-1, 'ATLANTIS', 3)", "INSERT INTO s VALUES (-2, LEMURIA, 4, 2.5)")


@query(
    f"""{_SUPPLIER}, CAST(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS rich FROM supplier"""
)
def ddl_add_column(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d, "ALTER TABLE s ADD COLUMN rich INT", "UPDATE s SET rich = s_acctbal > 0")


@query(
    """SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier"""
)
def ddl_drop_column(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d, "ALTER TABLE s DROP COLUMN s_acctbal")


@query(
    """SELECT s_suppkey, s_name AS title, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"""
)
def ddl_rename_column(spark: SparkSession, d: str) -> DataFrame:
    return changed(spark, d, "ALTER TABLE s RENAME COLUMN s_name TO title")


@query(
    f"""{_SUPPLIER.replace("s_acctbal", "CAST(s_suppkey AS VARCHAR) AS code")} FROM supplier"""
)
def ddl_alter_type(spark: SparkSession, d: str) -> DataFrame:
    return changed(
        spark, d, "ALTER TABLE s DROP COLUMN s_acctbal", "ALTER TABLE s ADD COLUMN code INT", "UPDATE s SET code = s_suppkey", "ALTER TABLE s ALTER COLUMN code TYPE VARCHAR(20)"
    )


@query(
    """SELECT count(*) AS cnt, count(*) AS cnt_key, coalesce(sum(CASE WHEN s_acctbal > 1e9 THEN s_acctbal END), 0) AS total,
    count(DISTINCT coalesce(CAST(CASE WHEN s_nationkey > 5 THEN s_nationkey END AS VARCHAR), '')) AS nations FROM supplier"""
)
def sql_compat(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of a compat workspace, asked for in SQL text."""
    ws = Workspace(spark, fresh_path(spark, "workspace"), "compat")
    execute(ws, "CREATE TABLE s (k INT, n INT, a DOUBLE)")
    ws.insert("s", table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") > 5, F.col("s_nationkey")), F.when(F.col("s_acctbal") > 1e9, F.col("s_acctbal"))))
    return execute(ws, "SELECT COUNT(*) AS cnt, COUNT(n) AS cnt_key, SUM(a) AS total, COUNT_DISTINCT(n) AS nations FROM s")


@query(
    """SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal >= 0)"""
)
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    return violations.check_rows(table(spark, d, "supplier"), "s_acctbal >= 0").select("s_suppkey", "s_acctbal")


@query(
    """SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    lost = violations.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")
    return lost.agg(aggregates.count().alias("orphans"))


@query(
    """SELECT c_nationkey, count(*) AS cnt FROM customer GROUP BY c_nationkey HAVING count(*) > 1"""
)
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return violations.duplicate_keys(table(spark, d, "customer"), "c_nationkey")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events"""
)
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The events written as CSV files and read again, all columns as text."""
    path = fresh_path(spark, "csv")
    csv.write_text(table(spark, d, "events").select("event_id", "event_type", "props"), path)
    return csv.read_text(spark, path)


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(c_acctbal > 0 AS VARCHAR) AS rich FROM customer"""
)
def csv_import(spark: SparkSession, d: str) -> DataFrame:
    """A workspace's table from CSV files, with the types that the values allow."""
    path = fresh_path(spark, "csv")
    csv.write_text(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") > 0).alias("rich")), path)
    ws = Workspace(spark, fresh_path(spark, "workspace"))
    ws.import_csv("c", path)
    return ws.table("c")


@query(
    f"""{_SUPPLIER} FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT -1, 'ATLANTIS', NULL, NULL"""
)
def catalog_reload(spark: SparkSession, d: str) -> DataFrame:
    """A workspace opened again by its catalog."""
    ws = filled(spark, d, "DELETE FROM s WHERE s_acctbal < 0", "INSERT INTO s (s_suppkey, s_name) VALUES (-1, ATLANTIS)")
    again = Workspace(spark, ws.catalog.root)
    again.vacuum()
    return again.table("s")


@query(
    f"""{_SUPPLIER}, CAST(7 AS BIGINT) AS refused FROM supplier"""
)
def constraints_refused(spark: SparkSession, d: str) -> DataFrame:
    """NOT NULL, type, length, CHECK, UNIQUE, primary and foreign key, tested by changes that leave the table as it was."""
    ws = filled(spark, d)
    execute(ws, "CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name VARCHAR(25) UNIQUE)")
    ws.insert("n", table(spark, d, "nation").select("n_nationkey", "n_name"))
    execute(ws, "ALTER TABLE s ADD FOREIGN KEY (s_nationkey) REFERENCES n(n_nationkey)")
    n = refused(
        ws, "INSERT INTO s VALUES (-1, NULL, 1, 0)", "INSERT INTO s VALUES (-1, 'x', 'many', 0)", "INSERT INTO s VALUES (1, 'x', 1, 0)", "INSERT INTO s VALUES (-1, 'x', -1, 0)",
        "INSERT INTO s VALUES (-1, 'x', 99, 0)", "DELETE FROM n WHERE n_nationkey > 0", "UPDATE s SET s_name = repeat(s_name, 9)",
    )
    return ws.table("s").withColumn("refused", F.lit(n).cast("long"))


@query(
    f"""{_SUPPLIER}, CASE WHEN s_acctbal > 0 THEN 'ok' ELSE 'warn' END AS state FROM supplier WHERE s_acctbal > -500"""
)
def constraints_added(spark: SparkSession, d: str) -> DataFrame:
    """Constraints added to a table that has rows, of which one does not hold until rows go."""
    ws = filled(spark, d, "ALTER TABLE s ADD COLUMN state ENUM('ok','warn')", "UPDATE s SET state = if(s_acctbal > 0, 'ok', 'warn')", "ALTER TABLE s ADD CONSTRAINT named UNIQUE (s_name)")
    if refused(ws, "ALTER TABLE s ADD CHECK (s_acctbal > -500)", "UPDATE s SET state = 'bad'") == 2:
        execute(ws, "DELETE FROM s WHERE s_acctbal <= -500")
    execute(ws, "ALTER TABLE s ADD CHECK (s_acctbal > -500)")
    return ws.table("s")


@query(
    """SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, count(*) AS cnt FROM supplier WHERE s_acctbal >= 0 GROUP BY s_nationkey"""
)
def script_run(spark: SparkSession, d: str) -> DataFrame:
    """A script of changes, then a query over the tables it leaves."""
    ws, said = filled(spark, d), []
    script = "-- positive ones only\nDELETE FROM s WHERE s_acctbal < 0; /* then */ ALTER TABLE s RENAME COLUMN s_acctbal TO balance;\nUPDATE s SET balance = 0;"
    if run_script(ws, script, said.append):
        raise RuntimeError("; ".join(said))
    return execute(ws, "SELECT s_nationkey, COUNT(*) AS cnt FROM s WHERE balance = 0 GROUP BY s_nationkey")
