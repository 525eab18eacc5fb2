"""Batch twins of the streaming windows over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live
from .corpus import table
from .registry import query


def _text_times(rows):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return rows.select(stamp("window_start"), stamp("window_end"), *[c for c in rows.columns if not c.startswith("window_")])


@query("E3", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, event_type, count(*) AS n
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type FROM events) GROUP BY w, event_type""")
def event_counts_tumbling(spark, sf):
    return _text_times(live.counts_per_window(table(spark, sf, "events"), "event_type"))


@query("E3", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(w + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS window_end, event_type, count(*) AS n
FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w, event_type FROM events) GROUP BY w, event_type""")
def event_counts_sliding(spark, sf):
    return _text_times(live.counts_per_window(table(spark, sf, "events"), "event_type", size="2 hours", slide="1 hour"))


@query("E3", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS window_end, user_id, count(*) AS n FROM k GROUP BY user_id, g""")
def event_counts_session(spark, sf):
    return _text_times(live.counts_per_session(table(spark, sf, "events"), "user_id"))
