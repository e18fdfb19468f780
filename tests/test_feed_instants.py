"""Instants as text, and how often the feed reads them."""

import datetime as dt

from pyspark.sql import functions as F

from tidepool.functions import temporal as T
from tidepool.operators import feed


def test_instants_in_utc_and_elsewhere(spark):
    at = lambda *x: dt.datetime(*x, tzinfo=dt.UTC).timestamp()
    want = {
        "2024-03-10T09:30:00.123Z": at(2024, 3, 10, 9, 30, 0, 123000), "2024-03-10T09:30Z": at(2024, 3, 10, 9, 30), "2024-03-10T09:30:15.1234567Z": at(2024, 3, 10, 9, 30, 15, 123456), "2024-03-10T09:30:00Z\n": at(2024, 3, 10, 9, 30),
        "2024-03-10T09:30:00+02": at(2024, 3, 10, 7, 30), "2024-03-10T09:30:00-07:30": at(2024, 3, 10, 17, 0), "2024-03-10T09:30:00+0130": at(2024, 3, 10, 8, 0),
        "2024-02-30T09:30:00Z": None, "2024-03-10T24:30:00Z": None, "2024-03-10T09:30:00": None, "2024-03-10 09:30:00Z": None, "2024-03-10T09:30:00z": None, "Z": None, "": None, "2024-03-10T09:30:00.Z": None,
    }
    rows = spark.createDataFrame([(x,) for x in [*want, None]], "text string").select("text", F.unix_micros(T.parse_instant(F.col("text"))).alias("at")).collect()
    assert {r["text"]: None if r["at"] is None else r["at"] / 1e6 for r in rows} == want | {None: None}


def test_ids_of_every_kind(spark):
    texts = ["1", "9007199254740991", "9007199254740992", "0", "-3", "5.0", "5.5", "5e0", '"5"', "true", "null", "123456789012345678901234567890"]
    got = spark.createDataFrame([(k, f'{{"id":{x}}}') for k, x in enumerate(texts)], "k int, text string").select("k", feed._id(F.parse_json("text"), "$.id").alias("id")).collect()
    assert [r["id"] for r in sorted(got)] == [1, 2**53 - 1, None, None, None, 5, None, 5, None, None, None, None]


def test_feed_reads_an_instant_once_for_a_rule(spark):
    """An instant's text is taken once to tell its shape, once for its parts in UTC, and not for each comparison."""
    plan = spark.range(1).select(feed.valid(F.parse_json(F.lit("{}"))).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("$.effectiveEndsAt") <= plan.count("$.startsAt")
