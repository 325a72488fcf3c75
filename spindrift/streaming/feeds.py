"""Structured Streaming: collection with overlap re-reads, stateful upserts, retention, timelines, watches, ledgers and late updates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.graph import shared_dir
from ..operators.setops import ledger_append, snapshot_diff


def read_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def collect(stream: DataFrame, key: str, time: str, overlap: str = "6 hours") -> DataFrame:
    """Items once each, although sources re-read an overlap: state is kept only as long as the overlap."""
    return stream.withWatermark(time, overlap).dropDuplicatesWithinWatermark([key])


def timeline(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Tumbling counts; a window is emitted once, when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bin"), by, "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str, late: str) -> DataFrame:
    """Activity sessions per group, closed by a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def with_activity(items: DataFrame, acts: DataFrame, slack: str, how: str = "leftOuter") -> DataFrame:
    """Stream-stream join: activity within slack of an item's time; both sides carry watermarks, so state is bounded.

    With leftOuter an item without activity comes once the watermark has passed its time and the slack.
    """
    i = items.withWatermark("ts", slack).alias("i")
    a = acts.withWatermark("at", slack).alias("a")
    close = (F.col("i.who") == F.col("a.who")) & (F.col("a.at") >= F.col("i.ts") - F.expr(f"interval {slack}")) & (F.col("a.at") <= F.col("i.ts") + F.expr(f"interval {slack}"))
    return i.join(a, close, how).select(F.col("i.id").alias("id"), F.col("a.act_id").alias("act_id"))


class Versions:
    """A table kept as numbered folders below root, one for each batch of one stream, whose checkpoint belongs to it.

    A batch reads only versions of earlier batches and writes its own, so a batch that is run again gives the same table;
    a new process finds the newest finished version by its record.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def newest(self, before: int | None = None) -> int | None:
        try:
            done = self.spark.read.schema("batch int").parquet(f"{self.root}/done")
            return done.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("batch").alias("n")).first()["n"]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest finished version, or that before a batch; None if there is none."""
        n = self.newest(before)
        return None if n is None else self.spark.read.parquet(f"{self.root}/rows/batch={n}")

    def read_all(self, before: int | None = None) -> DataFrame | None:
        """The rows of all finished batches, or of those before a batch, for tables to which batches add."""
        n = self.newest(before)
        return None if n is None else self.spark.read.parquet(f"{self.root}/rows").where(F.col("batch") <= n).drop("batch")

    def replace(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch}")
        self.spark.range(1).select(F.lit(batch).cast("int").alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.root}/done")


def _into(stream: DataFrame, table: Versions, step, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each batch makes the table's next version by step(version before, rows of the batch)."""
    return stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: table.replace(step(table.read(n), df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(state: DataFrame | None, batch: DataFrame, key: str, time: str) -> DataFrame:
    """One row per key: the newest version, first_seen kept, last_seen refreshed, updates counted where the time changed."""
    fresh = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), time).alias("r"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), (F.countDistinct(time) - 1).alias("updates"))
    fresh = fresh.select(key, "r.*", "first_seen", "last_seen", "updates")
    if state is None:
        return fresh
    rest = [c for c in fresh.columns if c not in (key, "first_seen", "last_seen", "updates")]
    both = state.unionByName(fresh)
    out = both.groupBy(key).agg(F.max_by(F.struct(*rest), "last_seen").alias("r"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), (F.sum("updates") + F.countDistinct("last_seen") - 1).alias("updates"))
    return out.select(key, "r.*", "first_seen", "last_seen", "updates")


def evict(state: DataFrame, now, retention: str) -> DataFrame:
    """Rows seen within the retention."""
    return state.where(F.col("last_seen") >= F.lit(now).cast("timestamp") - F.expr(f"interval {retention}"))


def upsert_stream(stream: DataFrame, table: Versions, key: str, time: str, checkpoint: str, retention: str | None = None) -> StreamingQuery:
    """Upserts of each batch; with a retention, rows last seen longer before the newest one are evicted."""

    def step(state: DataFrame | None, df: DataFrame) -> DataFrame:
        new = upsert(state, df, key, time)
        return new if retention is None else evict(new, new.agg(F.max("last_seen")).first()[0], retention)

    return _into(stream, table, step, checkpoint)


def ledger_stream(stream: DataFrame, table: Versions, key: str, checkpoint: str) -> StreamingQuery:
    """Rows by key, each once and as it first came, whatever is sent again: batches add their new rows, :meth:`Versions.read_all` reads them."""

    def step(df: DataFrame, n: int) -> None:
        ledger = table.read_all(n)
        table.replace(ledger_append(df.limit(0) if ledger is None else ledger, df, key), n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timeline_stream(stream: DataFrame, table: Versions, time: str, by: str, width: str, late: str, checkpoint: str) -> StreamingQuery:
    """Tumbling counts so far, open windows included: each batch updates the windows that it touches."""

    def step(state: DataFrame | None, df: DataFrame) -> DataFrame:
        return df if state is None else df.unionByName(state.join(df, ["bin", by], "left_anti"))

    return _into(timeline(stream, time, by, width, late), table, step, checkpoint, "update")


def sessions_stream(stream: DataFrame, table: Versions, time: str, by: str, gap: str, late: str, checkpoint: str) -> StreamingQuery:
    """All sessions so far, those still open included."""
    return _into(sessions(stream, time, by, gap, late), table, lambda state, df: df, checkpoint, "complete")


def watch_stream(stream: DataFrame, seen: Versions, queue: Versions, key: str, cols: list[str], checkpoint: str) -> StreamingQuery:
    """Each batch is a snapshot: its differences to the last one join the queue. Both tables are read as of the batch before, so a batch that is run again counts once."""

    def step(df: DataFrame, n: int) -> None:
        old, before = seen.read(n), queue.read(n)
        change = snapshot_diff(old if old is not None else df.limit(0), df, key, cols).withColumn("batch", F.lit(n))
        queue.replace(change if before is None else before.unionByName(change), n)
        seen.replace(df, n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def runs_stream(stream: DataFrame, items: Versions, log: Versions, key: str, by: str, time: str, keep: Column, checkpoint: str) -> StreamingQuery:
    """Collection with a log of its runs: kept rows join ``items`` once by key, and each batch adds a row a source to ``log``.

    log: batch, source, read, failed (rows without key or time), kept (of the others, those that ``keep`` holds for), new (kept
    keys that were not there), finished (the newest time read; null if none) and state: error if all rows failed, partial if
    some did, else ok. The row with a null source has the whole batch's counts, observed while its rows are written; rows
    without a source are only in it. Both tables are read as of the batch before, so a batch that is run again counts once.
    """

    def step(df: DataFrame, n: int) -> None:
        bad = F.col(key).isNull() | F.col(time).isNull()
        kept = ~bad & F.coalesce(keep, F.lit(False))
        seen, known = Observation(), items.read_all(n)
        counted = df.observe(seen, F.count("*").alias("read"), F.count_if(bad).alias("failed"), F.count_if(kept).alias("kept"), F.max(time).alias("finished"))
        items.replace(ledger_append(df.limit(0) if known is None else known, counted.where(kept), key), n)
        fresh = df.sparkSession.read.schema(df.schema).parquet(f"{items.root}/rows/batch={n}")
        total = seen.get
        one = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("source")).agg(F.count("*").alias("read"), F.count_if(bad).alias("failed"), F.count_if(kept).alias("kept"), F.max(time).alias("finished"))
        new = fresh.groupBy(F.col(by).alias("_s")).agg(F.count("*").alias("new"))
        one = one.join(new, F.col("source") == F.col("_s"), "left").select("source", "read", "failed", "kept", F.coalesce("new", F.lit(0)).alias("new"), "finished")
        whole = df.sparkSession.createDataFrame([(None, total["read"], total["failed"], total["kept"], fresh.count(), total["finished"])], one.schema)
        state = F.when((F.col("failed") > 0) & (F.col("failed") == F.col("read")), "error").when(F.col("failed") > 0, "partial").otherwise("ok")
        log.replace(one.unionByName(whole).select(F.lit(n).alias("run"), "*", state.alias("state")), n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_status(log: DataFrame, every: str, now: Column | None = None) -> DataFrame:
    """The newest run of each source with next_due, ``every`` after it finished, and whether that is past (null without ``now``)."""
    last = log.where(F.col("source").isNotNull()).groupBy("source").agg(F.max_by(F.struct("run", "read", "failed", "kept", "new", "finished", "state"), "run").alias("r"), F.sum("new").alias("collected"))
    due = F.col("r.finished") + F.expr(f"interval {every}")
    return last.select("source", "r.*", "collected", due.alias("next_due"), (due < now if now is not None else F.lit(None).cast("boolean")).alias("overdue"))


def queue_refresh(state: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Statuses after a new plan: finished work stays while its digest is the same, approvals fall when it changed, the rest is planned.

    state: key, digest, status; plan: key, digest, blocked.
    """
    s = state.select(F.col(key).alias("_k"), F.col("digest").alias("_d"), F.col("status").alias("_s"))
    same = F.col("_d").eqNullSafe(F.col("digest"))
    status = F.when(F.col("_s").isin("finished", "approved", "failed") & same, F.col("_s")).when(F.col("blocked"), "blocked").otherwise("planned")
    out = plan.join(s, F.col(key) == F.col("_k"), "left").withColumn("status", status)
    return out.select(key, "digest", "status", (F.col("_s").isNotNull() & (F.col("_s") != F.col("status"))).alias("changed"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is available now, through the stream's own state, into a written table."""
    spark = stream.sparkSession
    path = shared_dir(spark, name)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
