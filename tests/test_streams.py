"""Streaming state that survives restart and retry."""

from pyspark.sql import functions as F

from spindrift.streaming import feeds

SCHEMA = "id long, v int, at timestamp"


def write(spark, folder, n, rows):
    spark.createDataFrame(rows, "id long, v int, at string").select("id", "v", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, folder):
    return feeds.read_stream(spark, f"{folder}/*", "*.parquet", spark.createDataFrame([], SCHEMA).schema, 1)


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    folder, root, progress = (f"file://{tmp_path}/{n}" for n in ("in", "table", "progress"))
    run = lambda: feeds.upsert_stream(stream(spark, folder), feeds.Versions(spark, root), "id", "at", progress, "2 days").awaitTermination()
    assert feeds.Versions(spark, root).read() is None
    write(spark, folder, 0, [(1, 10, "2024-01-01 00:00:00"), (2, 20, "2024-01-02 00:00:00")])
    run()
    write(spark, folder, 1, [(1, 11, "2024-01-03 00:00:00")])
    run()  # a new table object, as in a new process
    got = {r["id"]: r for r in feeds.Versions(spark, root).read().collect()}
    assert got[1]["v"] == 11 and str(got[1]["first_seen"]) == "2024-01-01 00:00:00" and got[1]["updates"] == 1 and got[2]["v"] == 20
    write(spark, folder, 2, [(3, 30, "2024-01-05 00:00:00")])
    run()
    assert {r["id"] for r in feeds.Versions(spark, root).read().collect()} == {1, 3}  # 2 was last seen three days before


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    table = feeds.Versions(spark, f"file://{tmp_path}/table")
    row = lambda i, v: spark.createDataFrame([(i, v, "2024-01-01")], "id long, v int, at string")
    step = lambda df, n: table.replace(feeds.upsert(table.read(n), df, "id", "at"), n)
    step(row(1, 1), 0)
    step(row(2, 2), 1)
    step(row(2, 2), 1)
    assert sorted((r["id"], r["updates"]) for r in table.read().collect()) == [(1, 0), (2, 0)]
    assert [r["id"] for r in table.read(1).collect()] == [1]


def test_watch_and_ledger_survive_retries(spark, tmp_path):
    folder, progress = f"file://{tmp_path}/in", f"file://{tmp_path}/progress"
    seen, queue, ledger = (feeds.Versions(spark, f"file://{tmp_path}/{n}") for n in ("seen", "queue", "ledger"))
    for n, rows in enumerate([[(1, 1, "2024-01-01"), (2, 2, "2024-01-01")], [(2, 3, "2024-01-01"), (3, 3, "2024-01-01")]]):
        write(spark, folder, n, rows)
        feeds.watch_stream(stream(spark, folder), seen, queue, "id", ["v"], progress).awaitTermination()
        feeds.ledger_stream(stream(spark, folder), ledger, "id", f"{progress}-2").awaitTermination()
    changes = {(r["batch"], r["id"], r["change"]) for r in queue.read().collect()}
    assert {c for c in changes if c[0] == 1} == {(1, 1, "gone"), (1, 2, "changed"), (1, 3, "new")}
    assert sorted((r["id"], r["v"]) for r in ledger.read_all().collect()) == [(1, 1), (2, 2), (3, 3)]


def test_runs_are_logged_once_by_source(spark, tmp_path):
    folder, items, log, progress = (f"file://{tmp_path}/{n}" for n in ("in", "items", "log", "progress"))
    put = lambda n, rows: spark.createDataFrame(rows, "id long, source string, v int, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{n}")
    schema = spark.createDataFrame([], "id long, source string, v int, at timestamp").schema

    def run():
        rows = feeds.read_stream(spark, f"{folder}/*", "*.parquet", schema, 1)
        feeds.runs_stream(rows, feeds.Versions(spark, items), feeds.Versions(spark, log), "id", "source", "at", F.col("v") > 0, progress).awaitTermination()
        return {(r["run"], r["source"]): (r["read"], r["failed"], r["kept"], r["new"], r["state"]) for r in feeds.Versions(spark, log).read_all().collect()}

    put(0, [(1, "a", 5, "2024-01-01 00:00:00"), (1, "a", 5, "2024-01-01 00:00:00"), (2, "a", -1, "2024-01-01 01:00:00"), (None, "b", 5, "2024-01-01 00:00:00"), (3, None, 5, "2024-01-02 00:00:00"), (4, "c", None, "2024-01-02 00:00:00")])
    got = run()
    assert got == {(0, "a"): (3, 0, 2, 1, "ok"), (0, "b"): (1, 1, 0, 0, "error"), (0, "c"): (1, 0, 0, 0, "ok"), (0, None): (6, 1, 3, 2, "partial")}
    put(1, [(1, "a", 9, "2024-01-03 00:00:00"), (7, "a", 9, "2024-01-03 00:00:00"), (8, "b", 9, "2024-01-03 00:00:00"), (9, "b", 9, None)])
    got = {k: v for k, v in run().items() if k[0] == 1}
    assert got == {(1, "a"): (2, 0, 2, 1, "ok"), (1, "b"): (2, 1, 1, 1, "partial"), (1, None): (4, 1, 3, 2, "partial")}
    status = {r["source"]: r for r in feeds.run_status(feeds.Versions(spark, log).read_all(), "30 minutes", F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()}
    assert (status["a"]["run"], status["a"]["collected"], status["a"]["overdue"], status["c"]["overdue"], status["b"]["state"]) == (1, 2, False, True, "partial")
