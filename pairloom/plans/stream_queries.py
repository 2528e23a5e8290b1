"""Queries of the streaming extensions, on tables and on a stream of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.plans.base import table
from pairloom.streaming.stream import windowed

QUERIES, ORACLES = {}, {}


def events_windowed(spark, d):
    out = windowed(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


QUERIES["events_windowed"] = events_windowed
ORACLES["events_windowed"] = "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2"
