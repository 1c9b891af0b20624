from pyspark.sql import functions as F

from brindle.operators import aggregates, joins, ordering, violations


def users(spark):
    rows = [(1, "Alice", 25, "Engineering", 10), (2, "Bob", 30, "Sales", 20), (3, "Charlie", 20, "Engineering", 30)]
    return spark.createDataFrame(rows, "id long, name string, age long, department string, dept_id long")


def departments(spark):
    return spark.createDataFrame([(10, "Engineering"), (20, "Sales"), (40, "HR")], "dept_id long, dept_name string")


def test_join_counts(spark):
    u, d = users(spark), departments(spark)
    on = u.dept_id == d.dept_id
    assert [u.join(d, on, how).count() for how in ("inner", "left", "right", "full")] == [2, 3, 3, 4]
    assert u.crossJoin(d).count() == 9
    assert joins.join_star(u, d, ("u", "d"), None).columns[-1] == "d_dept_name"


def test_semi_and_anti(spark):
    u, d = users(spark), departments(spark)
    on = u.dept_id == d.dept_id
    assert [r.name for r in joins.exists_in(u, d, on).orderBy("id").collect()] == ["Alice", "Bob"]
    assert [r.name for r in joins.not_exists_in(u, d, on).collect()] == ["Charlie"]


def test_aggregates(spark):
    row = users(spark).agg(aggregates.count(), aggregates.total("age"), aggregates.average("age"), F.min("age"), F.max("age")).first()
    assert tuple(row) == (3, 75, 25.0, 20, 30)


def test_nulls_in_both_modes(spark):
    rows = [("Alice", 95), ("Alice", 95), ("Bob", 87), ("Bob", 92), ("Charlie", None), ("Charlie", 88), ("David", 0), ("David", -5)]
    s = spark.createDataFrame(rows, "name string, score long")
    ansi = s.agg(aggregates.count("score"), aggregates.count_distinct("score")).first()
    compat = s.agg(aggregates.count("score", "compat"), aggregates.count_distinct("score", semantics="compat")).first()
    assert tuple(ansi) == (7, 6) and tuple(compat) == (8, 7)
    none = s.where("1 = 0").agg(aggregates.total("score"), aggregates.total("score", "compat"), aggregates.average("score", "compat")).first()
    assert tuple(none) == (None, 0, 0.0)


def test_order_of_nulls(spark):
    df = spark.createDataFrame([(2, "b"), (None, None), (1, "a")], "n long, t string")
    order = lambda c, up: [r[c] for r in df.orderBy(ordering.order_key(df, c, up)).collect()]
    assert order("n", True) == [1, 2, None] and order("n", False) == [None, 2, 1]
    assert order("t", True) == [None, "a", "b"] and order("t", False) == ["b", "a", None]


def test_violations(spark):
    u, d = users(spark), departments(spark)
    assert violations.check_rows(u, "age > 21").count() == 1
    assert violations.orphans(u, "dept_id", d, "dept_id").count() == 1
    assert [r.department for r in violations.duplicate_keys(u, "department").collect()] == ["Engineering"]
    assert violations.check_rows(spark.createDataFrame([(None,)], "x long"), "x > 1").isEmpty()


def test_exemplar_and_distinct_order(spark):
    u = users(spark)
    assert u.groupBy("department").agg(aggregates.exemplar("name", "id").alias("n")).where("department = 'Engineering'").first().n == "Alice"
    assert [r.department for r in ordering.distinct_ordered(u, ["department"], "age").collect()] == ["Engineering", "Sales"]
