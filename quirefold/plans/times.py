"""Joins in time over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirefold.operators import timejoins
from quirefold.plans.registry import query, read


def _events(spark, sf_dir, kind):
    return read(spark, sf_dir, "events").where(F.col("event_type") == kind)


@query("""
WITH p AS (SELECT user_id, ts, event_id AS bought, value AS paid FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, p.bought, p.paid FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts
""")
def last_purchase(spark, sf_dir):
    """Every error with its user's last purchase at that time."""
    errors = _events(spark, sf_dir, "error").select("event_id", "user_id", "ts")
    bought = _events(spark, sf_dir, "purchase").select("user_id", "ts", F.col("event_id").alias("bought"), F.col("value").alias("paid"))
    return timejoins.as_of(errors, bought, "user_id", "ts", ["bought", "paid"], "bought").drop("ts")


@query("""
SELECT s.event_id, count(v.event_id) AS views, round(coalesce(sum(v.value), 0), 6) AS value FROM (SELECT * FROM events WHERE event_type = 'signup') s
LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = s.user_id AND v.ts >= s.ts AND v.ts < s.ts + to_microseconds((1 + s.event_id % 97 * s.event_id % 97 * 60) * 60000000::BIGINT) GROUP BY s.event_id
""")
def views_after_signup(spark, sf_dir):
    """The views in a time after each signup that is between a minute and some days long."""
    long_ = F.expr("make_dt_interval(0, 0, 1 + event_id % 97 * event_id % 97 * 60)")
    signups = _events(spark, sf_dir, "signup").select("user_id", F.col("event_id").alias("signup"), F.col("ts").alias("since"), (F.col("ts") + long_).alias("until"))
    views = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("seen"), "value")
    found = timejoins.points_in(signups, views, "user_id", "since", "until", "seen").groupBy("signup").agg(F.count(F.lit(1)).alias("views"), F.sum("value").alias("value"))
    every = signups.select(F.col("signup").alias("event_id")).join(found, F.col("event_id") == F.col("signup"), "left")
    return every.select("event_id", F.coalesce("views", F.lit(0)).alias("views"), F.round(F.coalesce("value", F.lit(0.0)), 6).alias("value"))
