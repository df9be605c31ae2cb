"""Every score of the stream comes out, with or without an outcome."""

from test_oracles import SF, duck, entry, table


def test_late_outcomes_has_every_score(spark):
    frame = entry.queries()["x04_late_outcomes_outer"](spark, SF)
    cursor = duck(SF).execute(entry.oracle_sql()["x04_late_outcomes_outer"])
    want = table([item[0] for item in cursor.description], cursor.fetchall())
    rows = [tuple(row) for row in frame.collect()]
    assert table(frame.columns, rows) == want
    assert any(row[1] is None for row in rows)
