import pytest
from pyspark.sql import functions as F

from brindle.functions.types import parse_type, supported


@pytest.mark.parametrize("text", ["INT", "integer", "VARCHAR(64)", "TEXT", "boolean", "FLOAT", "double  precision", "TIMESTAMP", "ENUM('a', 'b')", "Real"])
def test_supported(text):
    assert supported(text)


@pytest.mark.parametrize("text", ["BIT(8)", "DECIMAL(10,2)", "DATE", "TIME", "JSONB", "ARRAY(INT)", "VARCHAR(0)", "ENUM()", "ENUM(a)", ""])
def test_rejected(text):
    assert not supported(text)


def test_canonical_names():
    assert str(parse_type("varchar")) == "VARCHAR(255)"
    assert str(parse_type("enum( 'a','it''s' )")) == "ENUM('a','it''s')"


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("INT", ["1", " -7 ", "9223372036854775807"], ["x", "1.5", "9223372036854775808"]),
        ("BOOLEAN", ["1", "FALSE", "t"], ["yes", "2"]),
        ("TIMESTAMP", ["2024-10-01 14:30", "2024-10-01T14:30:25", "2024-10-01 14:30:25.5"], ["2024-13-01 12:00", "2024-10-01", "2024-02-30 10:00"]),
        ("DOUBLE", ["1", "1.5", "-2e3"], ["1,5", "abc"]),
        ("VARCHAR(3)", ["abc", "é"], ["abcd", "éé"]),
        ("ENUM('ok','warn')", ["ok"], ["fail"]),
    ],
)
def test_values(spark, kind, good, bad):
    df = spark.createDataFrame([(v, ok) for vs, ok in ((good, True), (bad, False)) for v in vs] + [("", True), (None, True)], "v string, ok boolean")
    t = parse_type(kind)
    for r in df.select("v", "ok", t.rejects(F.col("v")).alias("rejected"), t.value(F.col("v")).alias("value")).collect():
        assert bool(r.rejected) is not r.ok, r
        assert (r.value is None) == (not r.ok or not r.v), r
