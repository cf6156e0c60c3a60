"""Dates as scripts read them (values of `new Date(text)` in UTC)."""

from check_oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from webquarry.functions.transforms import parse_date

DATES = {
    "Mon, 02 Jan 2024 10:00:00 GMT": "2024-01-02T10:00:00.000Z", "Tue, 2 Jan 2024 10:00:00 +0200": "2024-01-02T08:00:00.000Z",
    "Tue Jan 02 2024 10:00:00 GMT-0530 (India Standard Time)": "2024-01-02T15:30:00.000Z", "January 2, 2024 3:04 PM": "2024-01-02T15:04:00.000Z",
    "Jan 2, 2024 12:04:05 am": "2024-01-02T00:04:05.000Z", "2 January 2024 10:00:05.25": "2024-01-02T10:00:05.250Z", "1/2/2024 10:30": "2024-01-02T10:30:00.000Z",
    "2024/1/2 10:30:00": "2024-01-02T10:30:00.000Z", "02-Jan-2024": "2024-01-02T00:00:00.000Z", "Sept 5 99": "1999-09-05T00:00:00.000Z", "2024 Mar 5": "2024-03-05T00:00:00.000Z",
    "Jan 2 2024 10:00 EST": "2024-01-02T15:00:00.000Z", "2/31/2024 1:00": "2024-03-02T01:00:00.000Z", "2024-01-02T10:00:00+02:00": "2024-01-02T08:00:00.000Z",
    "2024-01-02": "2024-01-02T00:00:00.000Z", "yesterday": None, "5th of Jan 2024": None, "13/13/2024 10:00": None, "Jan 2 2024 25:00": None, "1 2 3 4": None, "": None,
}


def test_dates(spark):
    rows = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", parse_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == DATES


def test_dates_of_events(spark, sf_dir):
    line = compare(spark, connect(sf_dir), sf_dir, "parse_dates", entry.queries()["parse_dates"], entry.oracle_sql()["parse_dates"])
    assert line.startswith("ok"), line
