"""Stored rollups: recomputed days replace theirs, days without rows lose theirs."""

import datetime as dt

from murmur.session import scratch_path
from murmur.sinks import read_rollup, write_rollup

ROWS = "date date, language string, n long"


def test_recomputed_days(spark):
    day = lambda m, d: dt.date(2024, m, d)
    path = scratch_path(spark, "test-rollup")
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    got = lambda: sorted((str(r.date), r.language, r.n) for r in read_rollup(spark, path).collect())
    write_rollup(frame([(day(1, 1), "lv", 1), (day(1, 2), "lv", 2), (day(2, 1), "lv", 3), (day(1, 1), "ru", 4)]), path)
    write_rollup(frame([(day(1, 1), "lv", 10)]), path)
    assert got() == [("2024-01-01", "lv", 10), ("2024-01-01", "ru", 4), ("2024-01-02", "lv", 2), ("2024-02-01", "lv", 3)]
    touched = frame([(day(1, 1), "lv", 0), (day(1, 2), "lv", 0), (day(2, 1), "lv", 0), (day(3, 1), "lv", 0)])
    write_rollup(frame([(day(1, 1), "lv", 11), (day(3, 1), "lv", 5)]), path, touched=touched)
    assert got() == [("2024-01-01", "lv", 11), ("2024-01-01", "ru", 4), ("2024-03-01", "lv", 5)]
    write_rollup(frame([]), path, touched=touched)
    assert got() == [("2024-01-01", "ru", 4)]
