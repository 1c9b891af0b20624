import pytest
from pyspark.sql import DataFrame

from brindle.plans.statements import StatementError, execute, parts, run_script, script_statements
from brindle.plans.workspace import ROW_ID, ConstraintError, Workspace
from brindle.sources import csv
from brindle.sources.catalog import Column


def filled(spark, root):
    w = Workspace(spark, str(root))
    w.create_table("departments", [Column("dept_id", "INT"), Column("dept_name", "VARCHAR(40)", not_null=True, unique=True)], ["dept_id"])
    w.create_table(
        "users",
        [Column("id", "INT"), Column("name", "VARCHAR(20)"), Column("age", "INT", check="age >= 0"), Column("dept_id", "INT", references="departments.dept_id"), Column("state", "ENUM('ok','warn')")],
        ["id"],
    )
    w.insert("departments", [(10, "Engineering"), (20, "Sales")])
    w.insert("users", [(1, "Alice", 25, 10, "ok"), (2, "Bob", 30, 20, "warn")])
    return w


@pytest.fixture
def ws(spark, tmp_path):
    return filled(spark, tmp_path / "data")


@pytest.fixture(scope="module")
def unchanged(spark, tmp_path_factory):
    return filled(spark, tmp_path_factory.mktemp("unchanged"))


def rows(w, name, *columns):
    return sorted(tuple(r) for r in w.table(name).select(*columns).collect())


@pytest.mark.parametrize(
    "change",
    [
        lambda w: w.insert("users", [(1, "X", 1, 10, "ok")]),
        lambda w: w.insert("users", [(3, "X", -1, 10, "ok")]),
        lambda w: w.insert("users", [(3, "X", "old", 10, "ok")]),
        lambda w: w.insert("users", [(3, "X", 1, 99, "ok")]),
        lambda w: w.insert("users", [(3, "X", 1, 10, "bad")]),
        lambda w: w.insert("users", [(3, "a name of more than twenty bytes", 1, 10, "ok")]),
        lambda w: w.insert("users", [(3, "X", 1, 10, "ok"), (3, "Y", 1, 10, "ok")]),
        lambda w: w.insert("departments", [(30, "Sales")]),
        lambda w: w.insert("departments", [(30,)], ["dept_id"]),
        lambda w: w.delete("departments", "dept_id = 10"),
        lambda w: w.update("departments", {"dept_id": "11"}, "dept_id = 10"),
        lambda w: w.update("users", {"age": "age - 26"}),
        lambda w: w.add_column("users", Column("z", "INT", not_null=True)),
        lambda w: w.drop_column("users", "id"),
        lambda w: w.drop_column("departments", "dept_id"),
        lambda w: w.alter_type("users", "name", "INT"),
        lambda w: w.add_constraint("users", check="age > 26"),
        lambda w: w.add_constraint("users", foreign_key=("age", "departments.dept_id")),
    ],
)
def test_refused_changes_leave_all_as_it_was(unchanged, change):
    ws = unchanged
    before = rows(ws, "users", "*"), rows(ws, "departments", "*")
    with pytest.raises(ConstraintError):
        change(ws)
    assert (rows(ws, "users", "*"), rows(ws, "departments", "*")) == before


def test_changes(ws, spark):
    ws.insert("users", [(3, "Carl")], ["id", "name"])
    ws.update("users", {"age": "age + 1", "name": "upper(name)"}, "id = 1")
    ws.add_column("users", Column("note", "TEXT"))
    ws.rename_column("users", "name", "full_name")
    ws.alter_type("users", "age", "VARCHAR(10)")
    ws.add_constraint("users", unique=["full_name"])
    ws.delete("users", "id = 2")
    assert rows(ws, "users", "id", "full_name", "age") == [(1, "ALICE", "26"), (3, "Carl", None)]
    ws.drop_column("users", "note")
    again = Workspace(spark, ws.catalog.root)
    assert again.catalog.get("USERS").names == ["id", "full_name", "age", "dept_id", "state"]
    assert again.catalog.get("users").column("full_name").unique
    assert spark.sql("select * from users join departments using (dept_id)").count() == 1


def test_rename_follows_references(ws):
    ws.add_constraint("users", check="age < 200 or name = 'age'")
    ws.rename_column("departments", "dept_id", "code")
    ws.rename_column("users", "age", "years")
    assert ws.catalog.get("users").column("dept_id").references == "departments.code"
    assert ws.catalog.get("users").checks == ["years < 200 or name = 'age'"]
    with pytest.raises(ConstraintError):
        ws.insert("users", [(3, "X", 1, 99, "ok")])


def test_failed_rename_changes_nothing(ws, spark, monkeypatch):
    ws.add_constraint("departments", check="dept_id > 0")
    for new in ("bad name", "dept_name", ""):
        with pytest.raises(ValueError):
            ws.rename_column("departments", "dept_id", new)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(ws.catalog, "save", lambda: (_ for _ in ()).throw(OSError("full")))
        ws.rename_column("departments", "dept_id", "code")
    for w in (ws, Workspace(spark, ws.catalog.root)):
        assert w.catalog.get("users").column("dept_id").references == "departments.dept_id"
        assert w.catalog.get("departments").names == ["dept_id", "dept_name"]
        assert rows(w, "departments", "dept_id") == [(10,), (20,)]


def test_insert_adds_a_snapshot_and_vacuum_removes_others(ws, spark):
    first = list(ws.catalog.get("users").snapshots)
    ws.insert("users", [(3, "Carl", 1, 20, "ok")])
    assert ws.catalog.get("users").snapshots[:-1] == first
    with pytest.raises(ConstraintError):
        ws.insert("users", [(3, "Dora", 1, 20, "ok")])
    ws.update("users", {"age": "age + 1"})
    assert len(ws.catalog.get("users").snapshots) == 1
    assert ws.vacuum() >= 4 and ws.vacuum() == 0
    assert rows(Workspace(spark, ws.catalog.root), "users", "id", "age") == [(1, 26), (2, 31), (3, 2)]


def test_catalog_survives_a_crash_between_write_and_rename(ws, spark, tmp_path):
    root = ws.catalog.root
    (tmp_path / "data" / "half.tmp").write_text("{")
    assert Workspace(spark, root).tables() == ws.tables()
    ws.insert("departments", [(30, "Art")])
    assert rows(Workspace(spark, root), "departments", "dept_id") == [(10,), (20,), (30,)]


def test_compat_in_sql_text(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "c"), semantics="compat")
    execute(w, "CREATE TABLE scores (name TEXT, score INT)")
    execute(w, "INSERT INTO scores VALUES (Alice, 95), ('Alice', 95), (Bob, 87), (Bob, 92), (Charlie, NULL), (Charlie, 88), (David, 0), (David, -5)")
    df = execute(w, "SELECT COUNT(score), COUNT(*), COUNT_DISTINCT(score), MIN(score) FROM scores")
    assert df.columns == ["COUNT(score)", "COUNT(*)", "COUNT_DISTINCT(score)", "MIN(score)"] and tuple(df.first()) == (8, 8, 7, -5)
    none = execute(w, "SELECT SUM(score), AVG(score), COUNT(score) FROM scores WHERE score > 1000")
    assert none.columns == ["SUM(score)", "AVG(score)", "COUNT(score)"] and tuple(none.first()) == (0, 0, 0)
    assert execute(w, "SELECT DISTINCT name FROM scores ORDER BY name LIMIT 2").count() == 1
    right = "SELECT a.name FROM scores a RIGHT JOIN (SELECT 'Bob' AS name) b ON a.name = b.name"
    assert execute(w, right).count() == 8
    assert execute(Workspace(spark, w.catalog.root), right).count() == 2
    assert tuple(execute(Workspace(spark, w.catalog.root), "SELECT COUNT(score), COUNT_DISTINCT(score) FROM scores").first()) == (7, 6)


def test_truth_values_and_long_keys(ws):
    execute(ws, "ALTER TABLE users ADD COLUMN old INT")
    execute(ws, "UPDATE users SET old = age > 26")
    assert rows(ws, "users", "id", "old") == [(1, 0), (2, 1)]
    with pytest.warns(UserWarning, match="not enforced"):
        execute(ws, "CREATE TABLE pairs (a INT, b INT, FOREIGN KEY (a, b) REFERENCES users(id, age))")
    execute(ws, "INSERT INTO pairs VALUES (1, 2)")
    assert rows(ws, "pairs", "a", "b") == [(1, 2)]


def test_compat_checks_fail_on_null(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "c"), semantics="compat")
    w.create_table("t", [Column("a", "INT", check="a > 0")])
    with pytest.raises(ConstraintError):
        w.insert("t", [(None,)])


def test_csv_round_trip(ws):
    ws.insert("users", [(3, 'q"u,\no', None, None, None)])
    ws.export_csv("users", ws.catalog.root + "/out")
    ws.import_csv("copy", ws.catalog.root + "/out")
    assert ws.catalog.get("copy").primary_key == ["id"] and ws.catalog.get("copy").column("age").type == "INT"
    assert rows(ws, "copy", "id", "name") == rows(ws, "users", "id", "name")
    assert [r.id for r in ws.first_rows("copy", ["state"]).where("state = 'ok'").collect()] == [1]


def test_csv_is_split_and_read_once(ws, spark, tmp_path, monkeypatch):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text("id,note\n" + "".join(f'{k},"a ""b"", {k}"\n' for k in range(2000)))
    broken.write_text('id,note\n1,"two\nlines"\n2,x\n')
    crlf, blank = tmp_path / "crlf.csv", tmp_path / "blank.csv"
    crlf.write_bytes(b"id,note\r\n1,x\r\n2,y\r\n")
    blank.write_text("note\n  \nx\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert csv.read_text(spark, str(plain)).rdd.getNumPartitions() > 1
        infer = csv.infer_types
        monkeypatch.setattr(csv, "infer_types", lambda texts: (plain.unlink(), infer(texts))[1])
        ws.import_csv("plain", str(plain))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    monkeypatch.undo()
    assert sorted(rows(ws, "plain", "id", "note")) == [(k, f'a "b", {k}') for k in range(2000)]
    assert [r.id for r in ws._stored(ws.catalog.get("plain")).orderBy(ROW_ID).collect()] == list(range(2000))
    for path, want in ((broken, [("1", "two\nlines"), ("2", "x")]), (crlf, [("1", "x"), ("2", "y")]), (blank, [("  ",), ("x",)])):
        assert sorted(tuple(r) for r in csv.read_text(spark, str(path)).collect()) == want


def test_splitting():
    assert list(parts("a, f(b, c), 'd, e'", ",")) == ["a", "f(b, c)", "'d, e'"]
    text = "select 1; -- a;b\n/* x;\n */ select\n 'a;''b';\n;select 2"
    assert [s for _, s in script_statements(text)] == ["select 1", "select\n 'a;''b'", "select 2"]
    with pytest.raises(StatementError):
        list(parts("select 'a", ";"))


SCRIPT = """
CREATE TABLE IF NOT EXISTS teams (id INT PRIMARY KEY, name VARCHAR(30) UNIQUE NOT NULL);
CREATE TABLE people (id INT PRIMARY KEY, name VARCHAR(30) NOT NULL, active BOOLEAN, seen TIMESTAMP, team INT REFERENCES teams(id),
  grade INT CHECK (grade >= 0), state ENUM('ok','warn','fail'), score DOUBLE DEFAULT 0, CHECK (id > 0));
INSERT INTO teams (id, name) VALUES (1, 'core'), (2, 'R&D; ops'), (3, 'none');
INSERT INTO people VALUES (1, 'ann', true, '2026-04-01 09:00:00', 1, 88, 'ok', 91.5), (2, 'bob', false, '2026-04-01 09:30:00', 1, 39, 'warn', 77.2),
  (3, 'cy', true, NULL, 2, 95, 'fail', 65.0);
UPDATE people SET grade = 40, state = 'ok' WHERE name = 'bob';
DELETE FROM people WHERE grade < 40;
ALTER TABLE people ADD COLUMN note TEXT;
ALTER TABLE people RENAME COLUMN note TO remark;
ALTER TABLE people ALTER COLUMN remark TYPE VARCHAR(80);
ALTER TABLE people ADD CONSTRAINT one UNIQUE (name);
ALTER TABLE people ADD CONSTRAINT FOREIGN KEY (team) REFERENCES teams(id);
ALTER TABLE people ADD CHECK (score >= 0);
ALTER TABLE people DROP COLUMN remark;
SELECT team, COUNT(*), AVG(grade) FROM people GROUP BY team HAVING COUNT(*) >= 1 ORDER BY COUNT(*) DESC;
SELECT COUNT_DISTINCT(team, state) FROM people WHERE name <> 'COUNT_DISTINCT(x)';
PATH SELECT name FROM people WHERE EXISTS (SELECT 1 FROM teams t WHERE t.id = people.team) ORDER BY name LIMIT 2;
"""


def test_script(spark, tmp_path):
    w, out = Workspace(spark, str(tmp_path / "s")), []
    assert run_script(w, SCRIPT, out.append) == 0, out
    text = "\n".join(out)
    assert "COUNT(*)" in text and "AVG(grade)" in text and "COUNT_DISTINCT(team, state)" in text
    assert "LeftSemi" in text and "TakeOrderedAndProject" in text and "16 statements, 0 failed" in text
    assert rows(w, "people", "id", "grade", "state") == [(1, 88, "ok"), (2, 40, "ok"), (3, 95, "fail")]
    assert isinstance(execute(w, "SELECT * FROM people"), DataFrame)


def test_script_errors(spark, tmp_path):
    w, out = Workspace(spark, str(tmp_path / "s")), []
    assert run_script(w, "CREATE TABLE a (x INT);\nNONSENSE;\n", out.append) == 1
    assert out == ["line 2: not a statement: NONSENSE"] and not w.tables()
    assert run_script(w, "CREATE TABLE a (x INT);\nINSERT INTO a VALUES ('q');\nINSERT INTO a VALUES (1);", out.append) == 1
    assert rows(w, "a", "x") == [(1,)] and out[-2].startswith("line 2: ConstraintError")
