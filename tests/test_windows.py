import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import windows
from tallyfold.functions.windows import DAY, Window, daily, epoch_micros, hourly, truncated_quotient

NOW = dt.datetime(2026, 5, 7, 12)


@pytest.mark.parametrize(("span", "n"), [(dt.timedelta(0), 1), (dt.timedelta(hours=1), 1), (DAY, 1), (DAY + dt.timedelta(seconds=1), 2), (7 * DAY, 7)])
def test_last(span, n):
    low, high = daily().last(NOW, span)
    assert high == daily().bucket_of(NOW) and high - low + 1 == n


def test_bucket_of_agrees_with_the_column(spark):
    times = [dt.datetime(1969, 12, 31, 5), dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1, 23, 59), NOW, dt.datetime(1901, 2, 3)]
    rows = spark.createDataFrame([(epoch_micros(t),) for t in times], "us bigint").select("us", F.timestamp_micros("us").alias("t"))
    for w in (daily(), hourly(), windows.minutely(), Window(dt.timedelta(0))):
        assert [r[0] for r in rows.select(w.bucket(F.col("t"))).collect()] == [w.bucket_of(t) for t in times]


def test_truncation(spark):
    got = spark.createDataFrame([(v,) for v in (-7, -5, -1, 0, 4, 5, 9)], "v bigint").select(truncated_quotient(F.col("v"), 5)).collect()
    assert [r[0] for r in got] == [-1, -1, 0, 0, 0, 1, 1]


def test_range_is_inclusive():
    assert daily().range(dt.datetime(2026, 5, 1, 23), dt.datetime(2026, 5, 3, 1)) == (daily().bucket_of(dt.datetime(2026, 5, 1)), daily().bucket_of(dt.datetime(2026, 5, 3)))
