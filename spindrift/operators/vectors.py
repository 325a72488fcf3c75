"""Vector tables: normalisation, similarity search, anchors and small learned scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a block of :func:`sim_pairs`.
BLOCK = 500
#: Queries of :func:`similar` that are compared with a block at once.
ASKED = 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(df: DataFrame, vector: str) -> DataFrame:
    """Unit vectors as doubles; a zero vector stays."""
    n = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn(vector, F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(F.transform(vector, lambda x: x.cast("double"))))


def _block_best(k: int):
    """query, key and cosine of the k best rows of a block for each query of a block; ties go to the smaller key."""
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("cosine", pa.float64())])

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        keys, asked = left["_k"].to_numpy(), right["_a"].to_numpy()
        u, v = (np.stack(t[c].to_numpy(zero_copy_only=False)) for t, c in ((left, "_u"), (right, "_v")))
        out = []
        for at in range(0, len(asked), ASKED):
            part, names = v[at : at + ASKED], asked[at : at + ASKED]
            dots = part @ u.T
            dots[names[:, None] == keys[None, :]] = -np.inf
            if dots.shape[1] > k:  # what may be among the k best after rounding
                near = dots >= np.partition(dots, -k, axis=1)[:, -k, None] - 2e-6
            else:
                near = np.ones(dots.shape, dtype=bool)
            i, j = np.nonzero(near & ~np.isneginf(dots))
            exact = np.zeros(len(i))
            for d in range(u.shape[1]):  # summed in the order of the dimensions, as dot does
                exact += u[j, d] * part[i, d]
            exact = np.sign(exact) * np.floor(np.abs(exact) * 1e6 + 0.5) / 1e6 + 0.0  # no -0.0
            order = np.lexsort((keys[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.Table.from_arrays([pa.array(names[i[kept]]), pa.array(keys[j[kept]]), pa.array(exact[kept])], schema=schema))
        return pa.concat_tables(out)

    return run


def similar(df: DataFrame, key: str, vector: str, k: int, every: int = 50, rows: int = 20_000, queries: int = 20_000) -> DataFrame:
    """For each query row (key divisible by ``every``) its k nearest other rows by cosine, exactly.

    Rows are dealt by hash into blocks, queries too, and each two blocks meet in a task of their own, as matrices; only the k best of a query
    leave it. Every query meets every row, so the time grows with the product of both, but no task holds more than two
    blocks. Rows without a key or a number in the vector take no part.
    """
    unit = normalize(df.select(F.col(key).cast("long").alias("_k"), F.col(vector).alias("_u")), "_u").where(F.col("_k").isNotNull() & (F.size("_u") > 0) & ~F.exists("_u", lambda x: x.isNull()))
    unit = unit.withColumn("_size", F.size("_u"))
    asked = unit.where(F.col("_k") % every == 0).select(F.col("_k").alias("_a"), F.col("_u").alias("_v"), F.col("_size").alias("_length"))
    n = unit.agg(F.count("*").alias("rows"), F.count_if(F.col("_k") % every == 0).alias("queries")).first()
    many, few = max(1, -(-n["rows"] // rows)), max(1, -(-n["queries"] // queries))
    left = unit.select("_k", "_u", "_size", F.pmod(F.xxhash64("_k"), F.lit(many)).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("_q"))
    right = asked.select("_a", "_v", "_length", F.pmod(F.xxhash64("_a"), F.lit(few)).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(many - 1)).cast("array<bigint>")).alias("_j"))
    found = left.groupBy("_size", "_b", "_q").cogroup(right.groupBy("_length", "_j", "_i")).applyInArrow(_block_best(k), "query long, key long, cosine double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "key"))  # k rows a block
    kind = df.schema[key].dataType
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return best.select(F.col("query").cast(kind).alias("query"), F.col("key").cast(kind).alias(key), F.round("cosine", 6).alias("cosine"), "place")


def _block_pairs(least: float):
    """a, b and cosine of the rows of two blocks (or of one with itself) that may reach the least."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = left["a"].to_numpy(), right["b"].to_numpy()
        u, v = (np.stack(t[c].to_numpy(zero_copy_only=False)) for t, c in ((left, "_u"), (right, "_v")))
        dots = np.zeros((len(x), len(y)))
        for d in range(u.shape[1]):  # summed in the order of the dimensions, as dot does
            dots += u[:, d, None] * v[None, :, d]
        near = ~(dots < least - 1e-6)
        if key[2].as_py() == key[3].as_py():
            near &= x[:, None] < y[None, :]
        i, j = np.nonzero(near)
        return pa.Table.from_arrays([pa.array(np.minimum(x[i], y[j])), pa.array(np.maximum(x[i], y[j])), pa.array(dots[i, j])], schema=schema)

    return run


def sim_pairs(df: DataFrame, key: str, by: str, vector: str, least: float, blocks: int | None = None) -> DataFrame:
    """a, b, cosine: pairs of rows of one group at least that similar.

    A group's rows are dealt by hash into blocks (``blocks`` of them, or one for each BLOCK rows), and each two blocks meet once, in a task of their
    own that holds no others; only pairs that are similar leave it. All pairs of a group are compared, so the time grows with
    the square of its size. Rows without a key, group, or a number in the vector have no pairs.
    """
    unit = normalize(df.select(F.col(by).alias("_g"), F.col(key).alias("_k"), F.col(vector).alias("_u")), "_u").where(F.col("_k").isNotNull() & ~F.exists("_u", lambda x: x.isNull())).where(F.size("_u") > 0)
    sizes = unit.groupBy("_g").agg((F.lit(blocks) if blocks else F.ceil(F.count("*") / BLOCK)).cast("int").alias("_n"))
    unit = unit.join(sizes, "_g").withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int")).withColumn("_size", F.size("_u"))
    unit = unit.withColumn("_k", F.col("_k").cast("long"))
    left = unit.select("_g", "_size", F.col("_k").alias("a"), "_u", F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_n") - 1)).alias("_j"))
    right = unit.select(F.col("_g").alias("_h"), F.col("_size").alias("_length"), F.col("_k").alias("b"), F.col("_u").alias("_v"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_p"), F.col("_b").alias("_q"))
    found = left.groupBy("_g", "_size", "_i", "_j").cogroup(right.groupBy("_h", "_length", "_p", "_q")).applyInArrow(_block_pairs(least), "a long, b long, cosine double")
    kind = df.schema[key].dataType
    return found.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), F.round("cosine", 6).alias("cosine")).where(F.col("cosine") >= least)


def anchor_score(df: DataFrame, key: str, vector: str, anchors: DataFrame, floor: float, ceiling: float) -> DataFrame:
    """key, best anchor and its cosine rescaled from floor..ceiling to 0..1. anchors: anchor, vector; a handful of rows."""
    unit, a = normalize(df.select(key, vector), vector), normalize(anchors.select("anchor", F.col(vector).alias("_a")), "_a")
    s = unit.join(F.broadcast(a)).select(key, "anchor", F.round(dot(F.col(vector), F.col("_a")), 9).alias("c"))  # anchors are a parameter-sized table
    best = s.groupBy(key).agg(F.max_by("anchor", F.struct("c", (-F.col("anchor")).alias("o"))).alias("anchor"), F.max("c").alias("c"))
    return best.select(key, "anchor", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c") - floor) / (ceiling - floor))).alias("score"))


def centroids(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector per group, summed by dimension."""
    flat = df.select(by, F.posexplode(vector).alias("d", "x")).groupBy(by, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vector))  # as many entries as dimensions


def main_direction(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, along: each vector's projection on the first principal direction (its Gram matrix is summed over all tasks)."""
    rows = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    model = PCA(k=1, inputCol="_v", outputCol="_p").fit(rows)
    sign = -1.0 if model.pc.toArray().sum() < 0 else 1.0
    return model.transform(rows).select(key, (vector_to_array("_p")[0] * sign).alias("along"))


def platt_fit(df: DataFrame, score: str, label: str, rounds: int = 15) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b) with smoothed targets, by Newton steps; each is one aggregate of five sums."""
    n = df.agg(F.sum(F.col(label).cast("double")).alias("p"), F.count("*").alias("n")).first()
    hi, lo = (n["p"] + 1) / (n["p"] + 2), 1 / (n["n"] - n["p"] + 2)
    target = F.when(F.col(label) == 1, hi).otherwise(lo)
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col(score) + F.lit(b))))
        g, w = p - target, p * (1 - p)
        r = df.agg(F.sum(g * F.col(score)).alias("ga"), F.sum(g).alias("gb"), F.sum(w * F.col(score) * F.col(score)).alias("haa"), F.sum(w * F.col(score)).alias("hab"), F.sum(w).alias("hbb")).first()
        haa, hbb = r["haa"] + 1e-9, r["hbb"] + 1e-9
        det = haa * hbb - r["hab"] ** 2
        a -= (hbb * r["ga"] - r["hab"] * r["gb"]) / det
        b -= (haa * r["gb"] - r["hab"] * r["ga"]) / det
    return a, b


def ridge_out_of_fold(df: DataFrame, key: str, vector: str, target: str, folds: int = 3, penalty: float = 0.1) -> DataFrame:
    """key, fold, predicted: ridge predictions of each fold by a model of the other folds, made monotone by an isotonic fit on those folds."""
    rows = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(target).cast("double").alias("label"), F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("fold"))
    out = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        ridge = LinearRegression(regParam=penalty, elasticNetParam=0.0).fit(train)
        steps = IsotonicRegression(featuresCol="prediction", predictionCol="calibrated").fit(ridge.transform(train))
        part = steps.transform(ridge.transform(test)).select(key, "fold", F.col("calibrated").alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out
