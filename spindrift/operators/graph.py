"""Iterative operators on edge tables. Each round is written to the shared folder, so lineage stays short and lost executors cost one round."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that are joined to components before the rounds, in one task at a time.
CHUNK = 1_000_000


def shared_dir(spark, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where the setting is missing and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forests(batches):
    """The edges of each chunk as stars: each node of a component of the chunk with its smallest node."""
    for batch in batches:
        names, ends = np.unique(np.concatenate([c.to_numpy(zero_copy_only=False) for c in batch.columns]), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(names))
        while True:
            low = np.minimum(root[a], root[b])
            now = root.copy()
            for side in (a, b):  # the root of each end, and the end itself, take the smaller root
                np.minimum.at(now, root[side], low)
                np.minimum.at(now, side, low)
            while not np.array_equal(now, now[now]):
                now = now[now]
            if np.array_equal(now, root):
                break
            root = now
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])


def _chunks(batches):
    """Arrow batches joined to chunks of at least CHUNK rows (but the last)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def components(nodes: DataFrame, edges: DataFrame, near: str | None = None) -> DataFrame:
    """node, component (smallest node of it). nodes: node; edges: a, b. Labels spread along edges, then jump to their label's label.

    Edges between whole numbers become stars of each chunk's components first, so what goes through the rounds is at most a
    row for each node of a chunk; with ``near``, a column that both ends of an edge share, chunks hold edges of the same values,
    and few rounds are left. Edges with an end that is no node count nowhere (with ``near`` there must be none). Nodes
    without an edge take no part in the rounds, and no round broadcasts.
    """
    nodes = nodes.select("node")
    if not near:
        for end in ("a", "b"):
            edges = edges.join(nodes.select(F.col("node").alias(end)).hint("merge"), end, "left_semi")
    whole = edges.schema["a"].dataType.typeName() in ("integer", "long") and edges.schema["a"].dataType == edges.schema["b"].dataType
    if whole:
        kind = edges.schema["a"].dataType.simpleString()
        some = edges.where("a is not null and b is not null and a <> b")
        some = some.repartition(near).select("a", "b") if near else some.select("a", "b")
        edges = written(some.mapInArrow(lambda batches: _forests(_chunks(batches)), f"a {kind}, b {kind}"), "stars")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.hint("merge").join(seen, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("now"))
        step = written(step, "labels")
        jump = step.alias("s").join(step.alias("t").hint("merge"), F.col("s.now") == F.col("t.node"), "left")
        new = written(jump.select(F.col("s.node").alias("node"), F.least("s.now", F.coalesce("t.now", "s.now")).alias("label"), F.col("s.label").alias("was")), "labels")
        done = new.where("label <> was").limit(1).count() == 0
        labels = new.select("node", "label")
        if done:
            found = labels.withColumnRenamed("node", "_n")
            return nodes.join(found.hint("merge"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce(F.col("label").cast(nodes.schema["node"].dataType), "node").alias("component"))


def potentials(both: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) and p, its potential relative to that node along some path. No round broadcasts.

    both: a, b, k with p(b) = p(a) + k, in both directions. Labels and offsets spread along edges, then jump over their
    label's own label, so long chains take few rounds.
    """
    state = written(both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"), F.lit(0).cast("long").alias("p")), "potentials")
    while True:
        # what a neighbour b says of a: its label, and p(a) = p(b) - k
        said = both.join(state.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min(F.struct("label", (F.col("p") - F.col("k")).alias("p"))).alias("near"))
        step = state.hint("merge").join(said, F.col("node") == F.col("a"), "left").withColumn("better", F.coalesce(F.col("near.label") < F.col("label"), F.lit(False)))
        step = step.select("node", F.col("label").alias("was"), F.when(F.col("better"), F.col("near.label")).otherwise(F.col("label")).alias("label"), F.when(F.col("better"), F.col("near.p")).otherwise(F.col("p")).alias("p"))
        step = written(step, "potentials")
        jump = step.alias("s").join(step.alias("t").hint("merge"), F.col("s.label") == F.col("t.node"), "left")
        new = written(jump.select(F.col("s.node").alias("node"), F.coalesce("t.label", "s.label").alias("label"), (F.col("s.p") + F.coalesce(F.col("t.p"), F.lit(0))).alias("p"), (F.coalesce("t.label", "s.label") != F.col("s.was")).alias("moved")), "potentials")
        state = new.select("node", "label", "p")
        if new.where("moved").limit(1).count() == 0:
            return state


def consistency(steps: DataFrame) -> DataFrame:
    """One row of findings about difference constraints p(b) - p(a) = k: self loops, conflicting pairs, components that hold a contradiction.

    Potentials spread from each component's smallest node; a constraint that they break makes its component inconsistent.
    """
    e = steps.select("a", "b", "k")
    loops = e.where("a = b").agg(F.count("*").alias("self_loops"))
    e = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("k")).otherwise(-F.col("k")).alias("k")).distinct()
    e = written(e, "constraints")
    pairs = e.groupBy("a", "b").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    conflicts = pairs.agg(F.count_if(F.col("n") > 1).alias("conflicting_pairs"))
    both = written(pairs.select("a", "b", "k").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("k")).alias("k"))), "constraints")
    known = potentials(both)
    pa, pb = known.select(F.col("node").alias("a"), "label", F.col("p").alias("pa")), known.select(F.col("node").alias("b"), F.col("p").alias("pb"))
    bad = e.join(pa.hint("merge"), "a").join(pb.hint("merge"), "b").where("pb - pa <> k").agg(F.countDistinct("label").alias("inconsistent"))
    one = known.agg(F.countDistinct("label").alias("components"))
    for row in (bad, loops, conflicts):  # each is one row
        one = one.join(F.broadcast(row))
    return one.select("components", "inconsistent", "self_loops", "conflicting_pairs")


def closure(links: DataFrame) -> DataFrame:
    """child, ancestor, depth for every chain of parent links; a chain ends where it would meet itself. links: child, parent."""
    base = written(links.select("child", "parent").distinct(), "links")
    found = base.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("child", "parent").alias("path")).where("child <> parent")
    out, front = [], written(found, "closure")
    while front.limit(1).count():
        out.append(front)
        nxt = front.join(base.withColumnsRenamed({"child": "c", "parent": "p"}), F.col("ancestor") == F.col("c")).where(~F.array_contains("path", F.col("p")))
        front = written(nxt.select("child", F.col("p").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("p")).alias("path")), "closure")
    result = out[0] if out else front
    for x in out[1:]:
        result = result.unionByName(x)
    return result.groupBy("child", "ancestor").agg(F.min("depth").alias("depth"))


def mesh_topology(tri: DataFrame) -> DataFrame:
    """One row: triangles, degenerate ones, edges used three times or more, directed edges used twice. tri: t, a, b, c."""
    ok = tri.where("a <> b and b <> c and a <> c")
    edges = ok.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")), F.struct(F.col("c").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    directed = edges.groupBy("u", "v").agg(F.count("*").alias("n"))
    flat = directed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    counts = flat.agg(F.count("*").alias("edges"), F.count_if(F.col("n") >= 3).alias("crowded"), F.count_if(F.col("most") >= 2).alias("repeated"))
    return tri.agg(F.count("*").alias("triangles"), F.count_if((F.col("a") == F.col("b")) | (F.col("b") == F.col("c")) | (F.col("a") == F.col("c"))).alias("degenerate")).join(F.broadcast(counts))  # each is one row


def line_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and RMS per group, from sums (so each group is one row per map task)."""
    g = df.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.covar_pop(x, y).alias("sxy"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    g = g.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    return g.withColumn("rms", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("sxy"))))


def drift_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """A line per group after one trim: rows farther from the first line than three MADs (at least one unit) are left out."""
    first = line_fit(df, by, x, y).select(*by, F.col("slope").alias("s0"), F.col("intercept").alias("i0"))
    r = df.join(first, by).withColumn("res", F.col(y) - F.col("i0") - F.col("s0") * F.col(x))
    mid = r.groupBy(*by).agg(F.percentile("res", F.lit(0.5)).alias("mid"))
    r = r.join(mid, by).withColumn("dev", F.abs(F.col("res") - F.col("mid")))
    mad = r.groupBy(*by).agg(F.greatest(F.lit(1.0), 3 * F.percentile("dev", F.lit(0.5))).alias("limit"))
    return line_fit(r.join(mad, by).where("dev <= limit"), by, x, y)
