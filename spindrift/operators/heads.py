"""Ridge heads over vectors, numbers and categories, with monotone calibration and a nested report.

Every row falls into one cell (outer fold, inner fold) per repetition, by hash of its key. One pass over the rows adds up
each cell's moments (features with themselves and with the target); any training set without a fold is a sum of cells, and
so are squared errors on it, so all models and the choice of penalties need no further pass. What reaches the driver is one
triangle of moments per cell, bounded by parameters.

Defined results: rows with a null or NaN target or without features (null, another length, NaN inside) are left out; rows of
one key fall into the same folds; null and NaN numbers are 0; null and unknown categories have no column set; further
columns are ignored; without rows there is no head (an error) and the nested report is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stats import mid_rank
from .vectors import dot

PENALTIES = tuple(float(x) for x in np.logspace(-2, 3, 20))


def levels(df: DataFrame, columns: list[str], most: int = 1000) -> dict[str, list]:
    """The distinct values of each column in order, at most ``most``."""
    out = {}
    for c in columns:
        found = [r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"{c} has more than {most} values")
        out[c] = sorted(found)
    return out


def features(vector: str | None, numbers: list[str], categories: dict[str, list]) -> Column:
    """One array: the vector, the numbers, then one 0/1 column per level of each category."""
    plain = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in numbers]
    hot = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, vs in categories.items() for v in vs]
    parts = [F.transform(vector, lambda x: x.cast("double"))] if vector else []
    return F.concat(*parts, F.array(*plain, *hot).cast("array<double>"))


def _moments(width: int):
    low = np.tril_indices(width + 2)

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            x = batch.column(3).flatten().to_numpy().reshape(-1, width)
            y = batch.column(4).to_numpy()
            rows = np.column_stack([np.ones(len(y)), x, y])
            kinds, of = np.unique(cells, axis=0, return_inverse=True)
            for i, cell in enumerate(map(tuple, kinds.tolist())):
                part = rows[of.reshape(-1) == i]
                held[cell] = held.get(cell, 0) + part.T @ part
        keys = list(held)
        cols = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([held[k][low].tolist() for k in keys], pa.list_(pa.float64()))], names=["rep", "outer", "inner", "moments"])

    return run


def _added(batches):
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for *key, moments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[tuple(key)] = held.get(tuple(key), 0) + np.array(moments)
    cols = [pa.array([k[i] for k in held], pa.int32()) for i in range(3)]
    yield pa.RecordBatch.from_arrays([*cols, pa.array([m.tolist() for m in held.values()], pa.list_(pa.float64()))], names=["rep", "outer", "inner", "moments"])


def _rows(df: DataFrame, key: str, target: str, x: Column, outer: int, inner: int, reps: int) -> tuple[DataFrame, int]:
    """rep, outer, inner, x, y, key of every usable row, and the length of x."""
    plain = df.select(F.col(key).alias("key"), F.col(target).cast("double").alias("y"), x.alias("x")).where(F.col("y").isNotNull() & ~F.isnan("y") & F.col("x").isNotNull())
    width = plain.agg(F.max(F.size("x"))).first()[0] or 0
    plain = plain.where((F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    fold = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("rep"), F.col("key")), F.lit(n)).cast("int")
    rows = plain.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return rows.select("rep", fold("outer", outer).alias("outer"), fold("inner", inner).alias("inner"), "x", "y", "key"), width


def _cells(rows: DataFrame, width: int) -> dict[tuple, np.ndarray]:
    kind = "rep int, outer int, inner int, moments array<double>"
    parts = rows.select("rep", "outer", "inner", "x", "y").mapInArrow(_moments(width), kind)
    low, out = np.tril_indices(width + 2), {}
    for r in parts.repartition("rep", "outer", "inner").mapInArrow(_added, kind).collect():  # one row per cell
        m = np.zeros((width + 2, width + 2))
        m[low] = r["moments"]
        out[r["rep"], r["outer"], r["inner"]] = m + np.tril(m, -1).T
    return out


def _solve(m: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights; the intercept bears no penalty."""
    keep = np.eye(len(m) - 1) * penalty
    keep[0, 0] = 0
    return np.linalg.lstsq(m[:-1, :-1] + keep, m[:-1, -1], rcond=None)[0]


def _error(m: np.ndarray, w: np.ndarray) -> float:
    v = np.append(w, -1.0)
    return float(v @ m @ v)


def choose(cells: dict[int, np.ndarray], penalties: tuple[float, ...]) -> tuple[float, np.ndarray, dict[int, np.ndarray]]:
    """The penalty of least squared error on held-out inner folds (ties: the first), the model of all, and those without one fold each."""
    total = sum(cells.values())
    tried = []
    for p in penalties:
        models = {i: _solve(total - m, p) for i, m in cells.items()}
        tried.append((sum(_error(m, models[i]) for i, m in cells.items()), p, models))
    _, penalty, models = min(tried, key=lambda t: t[0])
    return penalty, _solve(total, penalty), models


def _table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, kind))


def _predicted() -> Column:
    return F.element_at("w", 1) + dot(F.col("x"), F.slice("w", 2, F.size("w") - 1))


def knots(held: DataFrame, by: list[str], how: str, points: int = 41, accuracy: int = 10_000) -> dict[tuple, tuple[list, list]]:
    """Of each group of raw predictions p and targets y: raw and calibrated values at the knots, both ascending.

    ``quantile`` gives the k-th share of predictions the k-th share of targets (approximate quantiles), ``isotonic`` the
    expected target.
    """
    out = {}
    if how == "quantile":
        share = [i / (points - 1) for i in range(points)]
        for r in held.groupBy(*by).agg(F.percentile_approx("p", share, accuracy).alias("a"), F.percentile_approx("y", share, accuracy).alias("b")).collect():  # a row per model
            keep = [i for i in range(points) if i == 0 or r["a"][i] - r["a"][i - 1] > 1e-9]
            out[tuple(r[c] for c in by)] = ([r["a"][i] for i in keep], [r["b"][i] for i in keep])
    elif how == "isotonic":
        for group in held.select(*by).distinct().collect():
            part = held.where(" AND ".join(f"{c} = {group[c]}" for c in by) or "true")
            steps = IsotonicRegression(featuresCol="p", labelCol="y").fit(part)
            out[tuple(group)] = (steps.boundaries.toArray().tolist(), steps.predictions.toArray().tolist())
    else:
        raise ValueError(f"unknown calibration {how}")
    return out


def calibrated(p: Column, xs: Column, ys: Column) -> Column:
    """p between its knots in proportion, beyond them as the outermost."""
    i = F.size(F.filter(xs, lambda v: v <= p))
    j = F.greatest(F.lit(1), F.least(i, F.size(xs) - 1))
    x0, x1, y0, y1 = F.get(xs, j - 1), F.get(xs, j), F.get(ys, j - 1), F.get(ys, j)
    inside = F.when(x1 > x0, y0 + (y1 - y0) * (p - x0) / (x1 - x0)).otherwise(y1)
    return F.when(i == 0, F.get(ys, F.lit(0))).when(i >= F.size(xs), F.get(ys, F.size(xs) - 1)).otherwise(inside)


@dataclass
class Head:
    """A fitted head: score = intercept and weights on the features, then the knots."""

    penalty: float
    weights: list[float]
    xs: list[float]
    ys: list[float]

    def apply(self, x: Column) -> Column:
        """The calibrated score of a row's features; null where they are null or of another length."""
        raw = F.lit(self.weights[0]) + dot(x, F.array(*[F.lit(w) for w in self.weights[1:]]).cast("array<double>"))
        score = calibrated(raw, F.array(*[F.lit(v) for v in self.xs]), F.array(*[F.lit(v) for v in self.ys]))
        return F.when(F.size(x) == len(self.weights) - 1, score)


def fit_head(df: DataFrame, key: str, target: str, x: Column, inner: int = 5, penalties: tuple[float, ...] = PENALTIES, how: str = "quantile") -> Head:
    """The ridge head of all rows, calibrated on its out-of-fold predictions."""
    rows, width = _rows(df, key, target, x, 1, inner, 1)
    cells = {i: m for (_, _, i), m in _cells(rows, width).items()}
    if len(cells) < 2:
        raise ValueError("a head needs rows in two folds")
    penalty, all_of, models = choose(cells, penalties)
    table = _table(df.sparkSession, [(i, w.tolist()) for i, w in models.items()], "inner int, w array<double>")
    xs, ys = knots(rows.join(table, "inner").select(_predicted().alias("p"), "y"), [], how)[()]
    return Head(penalty, all_of.tolist(), xs, ys)



def nested_scores(df: DataFrame, key: str, target: str, x: Column, outer: int = 5, inner: int = 5, reps: int = 5, penalties: tuple[float, ...] = PENALTIES, how: str = "quantile") -> DataFrame:
    """rep, key, outer, y, penalty, raw, score: every row scored by a head, penalty and knots of the other outer folds."""
    spark = df.sparkSession
    rows, width = _rows(df, key, target, x, outer, inner, reps)
    cells = _cells(rows, width) if width else {}
    within, without = [], []
    for rep, k in sorted({(r, k) for r, k, _ in cells}):
        train: dict[int, np.ndarray] = {}
        for (r, o, i), m in cells.items():
            if r == rep and o != k:
                train[i] = train.get(i, 0) + m
        if len(train) < 2:
            continue
        penalty, model, models = choose(train, penalties)
        without.append((rep, k, penalty, model.tolist()))
        within += [(rep, k, i, w.tolist()) for i, w in models.items()]
    if not without:
        return rows.select("rep", "key", "outer", "y", F.lit(None).cast("double").alias("penalty"), F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("score")).where("false")
    inside = rows.withColumnRenamed("outer", "own").join(_table(spark, within, "rep int, outer int, inner int, w array<double>"), ["rep", "inner"]).where("own <> outer")
    at = knots(inside.select("rep", "outer", _predicted().alias("p"), "y"), ["rep", "outer"], how)
    table = _table(spark, [(*m, *at[m[0], m[1]]) for m in without], "rep int, outer int, penalty double, w array<double>, xs array<double>, ys array<double>")
    out = rows.join(table, ["rep", "outer"]).withColumn("raw", _predicted())
    return out.select("rep", "key", "outer", "y", "penalty", "raw", calibrated(F.col("raw"), F.col("xs"), F.col("ys")).alias("score"))


def band_report(scored: DataFrame, high: float) -> DataFrame:
    """Over repetitions: spearman, spearman_sd of score with y (mean ranks), high_precision, high_recall, high_items of score >= high against y >= high, rated_high."""
    ranked = mid_rank(mid_rank(scored.select("rep", "y", "score"), "score", ["rep"], "_s"), "y", ["rep"], "_y")
    hit, said, true = F.count_if((F.col("score") >= high) & (F.col("y") >= high)), F.count_if(F.col("score") >= high), F.count_if(F.col("y") >= high)
    each = ranked.groupBy("rep").agg(F.corr("_s", "_y").alias("rho"), (hit / F.greatest(said, F.lit(1))).alias("p"), (hit / F.greatest(true, F.lit(1))).alias("r"), said.alias("n"), true.alias("t"))
    out = each.agg(F.count("*").alias("reps"), F.avg("rho").alias("spearman"), F.stddev_pop("rho").alias("spearman_sd"), F.avg("p").alias("high_precision"), F.avg("r").alias("high_recall"), F.avg("n").alias("high_items"), F.avg("t").alias("rated_high"))
    return out.where("reps > 0")
