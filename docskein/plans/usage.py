"""Queries over call events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docskein.operators import evaluation as ev
from docskein.plans.registry import query, table
from docskein.streaming import ingest


def times(spark, folder):
    return table(spark, folder, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))


@query(
    """SELECT event_type AS model, grouping(event_type)::INT AS all_models, count(*) AS calls, sum(k)::BIGINT AS tokens_in, sum(greatest(k * 4, 100))::BIGINT AS tokens_out, count(*) FILTER (event_type = 'error') AS errors,
 round(avg((event_type = 'error')::INT) + 1e-9, 4) AS error_rate, round(avg(value) + 1e-9, 4) AS mean_latency FROM (SELECT *, (props->>'$.k')::INT AS k FROM events) GROUP BY ROLLUP (event_type)"""
)
def g_usage_summary(spark, folder):
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    calls = e.select(F.col("event_type").alias("model"), F.col("k").alias("tokens_in"), F.greatest(F.col("k") * 4, F.lit(100)).alias("tokens_out"), (F.col("event_type") == "error").alias("error"), F.col("value").alias("latency"))
    return ev.usage_summary(calls)


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, round(avg(value) + 1e-9, 4) AS mean, min(value) AS least, max(value) AS greatest, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1")
def g_timer_summary(spark, folder):
    return ev.timer_summary(times(spark, folder))


@query("SELECT event_type AS name, time_bucket(INTERVAL 3600 SECONDS, ts) AS start, count(*) AS calls, greatest(count(*) - 4, 0) AS over FROM events GROUP BY 1, 2")
def t_window_load(spark, folder):
    return ev.window_load(times(spark, folder), 3600, 4)


@query(
    """WITH i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
 SELECT user_id, min(ts) AS started, count(*) AS length FROM i WHERE event_type = 'error' GROUP BY user_id, island"""
)
def t_error_runs(spark, folder):
    e = table(spark, folder, "events").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("error"))
    return ev.error_runs(e)


@query("WITH k AS (SELECT user_id, event_type, props, count(*) AS n FROM events GROUP BY 1, 2, 3) SELECT sum(n)::BIGINT AS requests, count(*) AS distinct, round(1 - count(*) / sum(n), 4) AS hit_rate FROM k")
def t_cache_rate(spark, folder):
    return ev.cache_rate(table(spark, folder, "events"), ["user_id", "event_type", "props"])


@query("SELECT user_id AS step, event_type AS name, arg_max(value, (ts, event_id)) AS value FROM events WHERE value > 5 GROUP BY 1, 2")
def g_last_known(spark, folder):
    """Values of 5 or less count as missing measurements here."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("step"), F.col("event_type").alias("name"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("value") > 5, F.col("value")).alias("value"))
    return ev.last_known(e)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS calls, round(avg(value) + 1e-9, 6) AS mean FROM events GROUP BY 1, 2")
def t_call_load(spark, folder):
    return ingest.call_load(table(spark, folder, "events"), "ts", "event_type", "value").withColumn("mean", F.round("mean", 6))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS events FROM s GROUP BY user_id, i"""
)
def t_sessions(spark, folder):
    return ingest.sessions(table(spark, folder, "events"), "ts", "user_id", "6 hours")
