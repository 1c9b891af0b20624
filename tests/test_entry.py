import __spark_entry__ as entry


def test_contract():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) >= 60
