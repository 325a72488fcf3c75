"""Fits and transforms: affine landmark fits with leave-one-out errors, chains of affine steps, intervals and exact tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Sign patterns of more units than this are too many to list.
MOST_UNITS = 12


def fit_affine(df: DataFrame, by: list[str], xy: tuple[str, str], to: list[str]) -> DataFrame:
    """by, n and for each target t the fit t = t_x * x + t_y * y + t_0 by least squares, from sums by group; null where the points lie on a line."""
    x, y = (F.col(c).cast("double") for c in xy)
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"), F.covar_pop(x, y).alias("_xy"),
        *[a for t in to for a in (F.avg(t).alias(f"_{t}"), F.covar_pop(x, F.col(t).cast("double")).alias(f"_x{t}"), F.covar_pop(y, F.col(t).cast("double")).alias(f"_y{t}"))],
    )
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    det = F.when(det > 1e-12 * F.col("_xx") * F.col("_yy"), det)
    out = sums.withColumn("_det", det)
    for t in to:
        out = out.withColumn(f"{t}_x", (F.col(f"_x{t}") * F.col("_yy") - F.col(f"_y{t}") * F.col("_xy")) / F.col("_det")).withColumn(f"{t}_y", (F.col(f"_y{t}") * F.col("_xx") - F.col(f"_x{t}") * F.col("_xy")) / F.col("_det"))
        out = out.withColumn(f"{t}_0", F.col(f"_{t}") - F.col(f"{t}_x") * F.col("_x") - F.col(f"{t}_y") * F.col("_y"))
    return out


def loo_errors(df: DataFrame, by: list[str], xy: tuple[str, str], to: list[str]) -> DataFrame:
    """df with error, a row's distance from the fit of its group, and loo, that from the fit without the row (by its leverage, so nothing is fitted again)."""
    fit = fit_affine(df, by, xy, to)
    dx, dy = F.col(xy[0]) - F.col("_x"), F.col(xy[1]) - F.col("_y")
    leverage = 1 / F.col("n") + (dx * dx * F.col("_yy") - 2 * dx * dy * F.col("_xy") + dy * dy * F.col("_xx")) / (F.col("n") * F.col("_det"))
    off = sum((F.pow(F.col(t) - F.col(f"{t}_x") * F.col(xy[0]) - F.col(f"{t}_y") * F.col(xy[1]) - F.col(f"{t}_0"), F.lit(2)) for t in to), F.lit(0.0))
    out = df.join(fit, by).withColumn("error", F.sqrt(off)).withColumn("loo", F.sqrt(off) / F.when(leverage < 1 - 1e-9, 1 - leverage))
    return out.select(*[df[c] for c in df.columns], "error", "loo")


def fold_chain(steps: list[dict]) -> tuple[np.ndarray, float]:
    """One 3 x 4 matrix of the steps one after another (those marked ``inverted`` backwards), and the root of their errors' sum of squares."""
    total, errors = np.eye(4), 0.0
    for step in steps:
        m = np.vstack([np.array(step["matrix"], dtype=float).reshape(3, 4), [0, 0, 0, 1]])
        if step.get("inverted"):
            if abs(np.linalg.det(m[:3, :3])) < 1e-12:
                raise ValueError("a step that is flat cannot be inverted")
            m = np.linalg.inv(m)
        total, errors = m @ total, errors + step.get("error", 0.0) ** 2
    return total[:3], math.sqrt(errors)


def apply_chain(points: DataFrame, steps: list[dict], axes: tuple[str, str, str] = ("x", "y", "z"), prefix: str = "") -> DataFrame:
    """points with the moved coordinates (prefix and axis) and chain_error. The few steps are folded to one matrix of literals."""
    m, error = fold_chain(steps)
    at = [sum((F.col(a) * float(m[i, j]) for j, a in enumerate(axes)), F.lit(float(m[i, 3]))) for i in range(3)]
    return points.withColumns({f"{prefix}{a}": c for a, c in zip(axes, at, strict=True)} | {f"{prefix}chain_error": F.lit(error)})


def compare_revisions(points: DataFrame, old: list[dict], new: list[dict], by: list[str], axes: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """by, n, median, p90 and most: how far apart two revisions of a chain put the points."""
    both = apply_chain(apply_chain(points, old, axes, "old_"), new, axes, "new_")
    d = F.sqrt(sum((F.pow(F.col(f"old_{a}") - F.col(f"new_{a}"), F.lit(2)) for a in axes), F.lit(0.0)))
    return both.withColumn("d", d).groupBy(*by).agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("d", F.lit(0.9)).alias("p90"), F.max("d").alias("most"))


def t_quantile(p: float, df: int) -> float:
    """The quantile of Student's t distribution, by bisection of its distribution function (an integral by Simpson's rule over the angle)."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)

    def below(a: float) -> float:  # of t = sqrt(df) * tan(a)
        n = 2000
        x = np.linspace(0, a, n + 1)
        f = np.cos(x) ** (df - 1)
        return 0.5 + c * a / n / 3 * float(f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())

    low, high = 0.0, math.pi / 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return math.sqrt(df) * math.tan((low + high) / 2)


def t_interval(df: DataFrame, by: list[str], value: str, level: float = 0.95, most: int = 200, freedom: int | None = None) -> DataFrame:
    """by, n, mean, low and high of the mean's t interval; null ends for one row. With ``freedom``, all groups take the quantile of
    so many degrees of freedom (blocks planned for one size, of which the last may be short). Quantiles of up to ``most`` degrees of freedom are a broadcast table, beyond it their series about the normal one."""
    p, z = 0.5 + level / 2, 0.0
    groups = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ends = lambda out, q: out.select(*by, "n", "mean", *[(F.col("mean") + k * F.when(F.col("n") > 1, q * F.col("sd") / F.sqrt("n"))).alias(c) for c, k in (("low", -1), ("high", 1))])
    if freedom:
        return ends(groups, F.lit(t_quantile(p, freedom)))
    table = df.sparkSession.createDataFrame([(i + 1, t_quantile(p, i)) for i in range(1, most + 1)], "n long, q double")
    low, high = 0.0, 10.0
    for _ in range(80):  # of the normal distribution
        z = (low + high) / 2
        low, high = (z, high) if 0.5 * (1 + math.erf(z / math.sqrt(2))) < p else (low, z)
    k = F.col("n") - 1
    series = z + (z**3 + z) / 4 / k + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (k * k)
    return ends(groups.join(F.broadcast(table), "n", "left"), F.coalesce("q", series))  # ``most`` rows


def sign_flip_exact(units: DataFrame, value: str) -> DataFrame:
    """One row: n, observed (the mean), patterns and p, the share of all 2 ** n sign patterns whose mean is as far from 0. units: at most MOST_UNITS rows."""
    rows = [r[0] for r in units.select(value).where(F.col(value).isNotNull()).limit(MOST_UNITS + 1).collect()]
    n = len(rows)
    if n > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} units: draw patterns instead of listing all")
    numbered = units.sparkSession.createDataFrame(list(enumerate(map(float, rows))), "i int, d double")
    flips = units.sparkSession.range(1 << n).join(F.broadcast(numbered)).withColumn("s", F.when(F.getbit("id", "i") == 1, -F.col("d")).otherwise(F.col("d")))  # at most MOST_UNITS rows
    means = flips.groupBy("id").agg(F.avg("s").alias("m"))
    seen = F.max(F.when(F.col("id") == 0, F.col("m")))
    observed = means.agg(seen.alias("o"))
    far = F.count_if(F.abs("m") >= F.abs("o") - 1e-12)
    return means.join(F.broadcast(observed)).agg(F.lit(n).alias("n"), F.first("o").alias("observed"), F.count("*").alias("patterns"), (far / F.count("*")).alias("p"))  # one row


def permuted_gap(df: DataFrame, key: Column, score: str, label: str, draws: int, draw_of) -> DataFrame:
    """draw, gap: the difference of mean scores between labels 1 and 0, in the data (draw 0) and with the labels dealt anew.

    In a draw the rows of smallest hash take label 1, as many as have it; rows are ranked by counting hashes in buckets
    first, so no task orders all rows. draw_of(key, draw) is an integer hash below 2 ** 31.
    """
    rows = df.select(key.cast("long").alias("_k"), F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_l"))
    positives = rows.agg(F.sum("_l").alias("_n"))
    many = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", draw_of(F.col("_k"), F.col("draw").cast("long"))).withColumn("_b", F.floor(F.col("_h") / 1_000_000))
    buckets = many.groupBy("draw", "_b").agg(F.count("*").alias("_c"))
    before = buckets.withColumn("_before", F.sum("_c").over(W.partitionBy("draw").orderBy("_b")) - F.col("_c"))  # at most 2,148 buckets a draw
    rank = F.row_number().over(W.partitionBy("draw", "_b").orderBy("_h", "_k")) + F.col("_before")
    dealt = many.join(before, ["draw", "_b"]).withColumn("_r", rank).join(F.broadcast(positives)).select("draw", "_s", (F.col("_r") <= F.col("_n")).cast("int").alias("_l"))  # one row
    every = dealt.unionByName(rows.select(F.lit(0).alias("draw"), "_s", "_l"))
    return every.groupBy("draw").agg((F.avg(F.when(F.col("_l") == 1, F.col("_s"))) - F.avg(F.when(F.col("_l") == 0, F.col("_s")))).alias("gap"))


def permutation_p(gaps: DataFrame) -> DataFrame:
    """One row: observed, draws and p = (1 + draws with a gap as far from 0) / (1 + draws)."""
    observed = gaps.where("draw = 0").select(F.col("gap").alias("observed"))
    far = F.count_if(F.abs("gap") >= F.abs("observed") - 1e-12)
    return gaps.where("draw > 0").join(F.broadcast(observed)).agg(F.first("observed").alias("observed"), F.count("*").alias("draws"), ((1 + far) / (1 + F.count("*"))).alias("p"))  # one row
