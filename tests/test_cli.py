import pytest

from brindle import cli
from brindle.plans.statements import StatementError, execute, render
from brindle.plans.workspace import Workspace


def test_options():
    assert cli.options(["-q", "SELECT 1"]).query == "SELECT 1"
    assert cli.options(["--repl"]).repl
    for bad in (["-q", "SELECT 1", "-f", "x"], ["-q"], ["--nothing"]):
        with pytest.raises(SystemExit) as e:
            cli.options(bad)
        assert e.value.code == 2


def test_session(spark, tmp_path, monkeypatch, capsys):
    w = Workspace(spark, str(tmp_path / "d"))
    execute(w, "CREATE TABLE a (x INT PRIMARY KEY, y TEXT)")
    lines = iter([".tables", ".schema a", "INSERT INTO a", "VALUES (1, 'one');", "SELECT nope FROM a;", "SELECT * FROM a;", ".quit"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    monkeypatch.setenv("HOME", str(tmp_path))
    cli.repl(w)
    out = capsys.readouterr().out
    assert "a (2 columns)" in out and "x INT PRIMARY KEY" in out and "AnalysisException" in out and "(1 rows)" in out


def test_statements_of_one_line_all_run(spark, tmp_path, monkeypatch, capsys):
    w = Workspace(spark, str(tmp_path / "d"))
    with pytest.raises(StatementError):
        execute(w, "CREATE TABLE a (x INT); CREATE TABLE b (x INT);")
    lines = iter(["CREATE TABLE a (x INT); CREATE TABLE b (x INT); SELECT 1 AS one; SELECT 2 AS two;", ".quit"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    monkeypatch.setenv("HOME", str(tmp_path))
    cli.repl(w)
    out = capsys.readouterr().out
    assert sorted(w.tables()) == ["a", "b"] and "one" in out and "two" in out


def test_folder_of_csv_files(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "people.csv").write_text("id,name\n1,ann\n2,bob\n")
    (tmp_path / "in" / "towns.csv").write_text("id,name\n7,rome\n")
    w = Workspace(spark, str(tmp_path / "d"))
    assert cli.meta(w, f".open {tmp_path / 'in'}") and capsys.readouterr().out.split() == ["people", "towns"]
    assert w.import_folder(str(tmp_path / "in")) == [] and sorted(w.tables()) == ["people", "towns"]
    w.import_csv("towns", str(tmp_path / "in" / "people.csv"))  # the same columns: its rows are replaced
    assert w.table("towns").count() == 2
    (tmp_path / "other.csv").write_text("id,title\n1,x\n")
    with pytest.raises(ValueError, match="has columns id, title"):
        w.import_csv("towns", str(tmp_path / "other.csv"))


def test_whole_results_are_shown_and_can_be_written(spark, tmp_path, monkeypatch, capsys):
    assert list(render(spark.range(3), sized_by=1)) == ["id", "--", " 0", " 1", " 2", "(3 rows)"]
    assert list(render(spark.range(0)))[-1] == "(0 rows)"
    monkeypatch.setattr(cli, "build_session", lambda: spark)
    query = ["--data", str(tmp_path / "d"), "-q", "SELECT id FROM range(1500)"]
    assert cli.main(query) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[-1] == "(1500 rows)" and len(lines) == 1503
    for name, read in (("t", spark.read.parquet), ("t.csv", lambda p: spark.read.csv(p, header=True))):
        assert cli.main([*query, "-o", str(tmp_path / name)]) == 0
        assert read(str(tmp_path / name)).count() == 1500
    with pytest.raises(SystemExit):
        cli.options(["--repl", "-o", "x"])
