"""Queries of the streaming operators: each reads the events as a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..streaming import feeds
from .registry import query


def _events(t):
    return feeds.read_stream(t.spark, t.folder, "events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("r1_collect", sql="SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def r1(t):
    doubled = _events(t).withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    rows = feeds.run_to_table(feeds.collect(doubled, "event_id", "ts", "40 days"), "collected")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def _table(t, name):
    """A table of versions and the folder of its stream's progress."""
    return feeds.Versions(t.spark, shared_dir(t.spark, name)), shared_dir(t.spark, "progress")


@query("r2_upsert", sql="SELECT user_id, arg_max(event_type, ts) AS event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT ts) - 1 AS updates FROM events GROUP BY 1")
def r2(t):
    table, progress = _table(t, "items")
    feeds.upsert_stream(_events(t).select("user_id", "event_type", "ts"), table, "user_id", "ts", progress).awaitTermination()
    return table.read().select("user_id", "event_type", "first_seen", "last_seen", "updates")


@query("r3_evict", sql="SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 12 HOURS")
def r3(t):
    table, progress = _table(t, "items")
    feeds.upsert_stream(_events(t).select("user_id", "event_type", "ts"), table, "user_id", "ts", progress, "12 hours").awaitTermination()
    return table.read().select("user_id", "last_seen")


@query("r4_stream_timeline", sql="SELECT time_bucket(INTERVAL 6 HOURS, ts) AS bin, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r4(t):
    table, progress = _table(t, "timeline")
    feeds.timeline_stream(_events(t), table, "ts", "event_type", "6 hours", "1 hour", progress).awaitTermination()
    return table.read()


@query("r7_ledger_stream", sql="SELECT event_id, user_id, value FROM events")
def r7(t):
    table, progress = _table(t, "ledger")
    sent = _events(t).withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).select("event_id", "user_id", "value")
    feeds.ledger_stream(sent, table, "event_id", progress).awaitTermination()
    return table.read_all()


@query("r9_late_activity", sql="""
SELECT i.event_id AS id, a.event_id AS act_id FROM events i JOIN events a ON i.event_type = 'purchase' AND a.event_type = 'click' AND a.user_id = i.user_id AND a.ts BETWEEN i.ts - INTERVAL 2 HOURS AND i.ts + INTERVAL 2 HOURS""")
def r9(t):
    items = _events(t).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), "ts")
    acts = _events(t).where("event_type = 'click'").select(F.col("event_id").alias("act_id"), F.col("user_id").alias("who"), F.col("ts").alias("at"))
    return feeds.run_to_table(feeds.with_activity(items, acts, "2 hours", "inner"), "activity")


@query("r10_stream_sessions", sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def r10(t):
    table, progress = _table(t, "sessions")
    feeds.sessions_stream(_events(t), table, "ts", "user_id", "6 hours", "1 hour", progress).awaitTermination()
    return table.read()


@query("r6_watch", views="cat_old cat_new", sql="""
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM cat_old o FULL JOIN cat_new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.val <> n.val OR o.grp <> n.grp""")
def r6(t):
    folder = shared_dir(t.spark, "snapshots")
    seen, progress = _table(t, "seen")
    queue = feeds.Versions(t.spark, shared_dir(t.spark, "queue"))
    for n, snapshot in enumerate((t.cat_old, t.cat_new)):  # each arrives as a batch of its own: a batch takes all files that are new
        snapshot.write.parquet(f"{folder}/{n}")
        stream = feeds.read_stream(t.spark, f"{folder}/*", "*.parquet", t.cat_old.schema, 1_000_000)
        feeds.watch_stream(stream, seen, queue, "id", ["grp", "val"], progress).awaitTermination()
    return queue.read().where("batch > 0").select("id", "change")


@query("r8_queue_refresh", views="bill", sql="""
WITH s AS (SELECT job_id, md5(cost::BIGINT::VARCHAR) AS digest, CASE job_id % 3 WHEN 0 THEN 'finished' WHEN 1 THEN 'approved' ELSE 'running' END AS status FROM bill WHERE job_id % 4 <> 0), p AS (SELECT job_id, md5((cost::BIGINT + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS digest, state = 'running' AND cost > 400000 AS blocked FROM bill)
SELECT p.job_id, p.digest, CASE WHEN s.status IN ('finished', 'approved', 'failed') AND s.digest = p.digest THEN s.status WHEN blocked THEN 'blocked' ELSE 'planned' END AS status, s.status IS NOT NULL AND s.status <> CASE WHEN s.status IN ('finished', 'approved', 'failed') AND s.digest = p.digest THEN s.status WHEN blocked THEN 'blocked' ELSE 'planned' END AS changed FROM p LEFT JOIN s USING (job_id)""".replace("cost::BIGINT", "floor(cost)::BIGINT"))
def r8(t):
    cents = F.floor("cost")
    status = F.when(F.col("job_id") % 3 == 0, "finished").when(F.col("job_id") % 3 == 1, "approved").otherwise("running")
    state = t.bill.where("job_id % 4 <> 0").select("job_id", F.md5(cents.cast("string")).alias("digest"), status.alias("status"))
    plan = t.bill.select("job_id", F.md5((cents + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0)).cast("string")).alias("digest"), ((F.col("state") == "running") & (F.col("cost") > 400000)).alias("blocked"))
    return feeds.queue_refresh(state, plan, "job_id")


# every 50th event comes without a key, sources read in one batch
@query("r5_run_log", sql="""
WITH e AS (SELECT event_type AS source, CASE WHEN event_id % 50 <> 0 THEN event_id END AS id, ts, value FROM events), r AS (SELECT source, count(*) AS read, count(*) FILTER (id IS NULL) AS failed, count(*) FILTER (id IS NOT NULL AND value > 5) AS kept, count(DISTINCT id) FILTER (value > 5) AS "new", max(ts) AS finished FROM e GROUP BY GROUPING SETS ((source), ()))
SELECT source, read, failed, kept, "new", finished, CASE WHEN failed = read THEN 'error' WHEN failed > 0 THEN 'partial' ELSE 'ok' END AS state FROM r""")
def r5_log(t):
    return _run_log(t).drop("run")


def _run_log(t):
    items, progress = _table(t, "items")
    log, _ = _table(t, "runs")
    rows = _events(t).select(F.when(F.col("event_id") % 50 != 0, F.col("event_id")).alias("id"), F.col("event_type").alias("source"), "ts", "value")
    feeds.runs_stream(rows, items, log, "id", "source", "ts", F.col("value") > 5, progress).awaitTermination()
    return log.read_all()


@query("r5_run_status", sql="""
WITH e AS (SELECT event_type AS source, CASE WHEN event_id % 50 <> 0 THEN event_id END AS id, ts, value FROM events), n AS (SELECT max(ts) + INTERVAL 15 MINUTES AS now FROM events)
SELECT source, count(*) FILTER (id IS NOT NULL AND value > 5) AS collected, max(ts) + INTERVAL 30 MINUTES AS next_due, max(ts) + INTERVAL 30 MINUTES < any_value(now) AS overdue FROM e, n GROUP BY 1""")
def r5_status(t):
    now = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first()["m"]
    return feeds.run_status(_run_log(t), "30 minutes", F.lit(now) + F.expr("interval 15 minutes")).select("source", "collected", "next_due", "overdue")
