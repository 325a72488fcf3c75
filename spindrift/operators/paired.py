"""Paired readouts by cluster bootstrap, and the controls that a readout must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written
from .resampling import draw, resample_weights


def _levels(df: DataFrame, diff: Column, unit: str) -> DataFrame:
    """unit, d, n: how often each difference occurs in each cluster; rows without a difference are left out."""
    rows = df.select(F.col(unit).cast("long").alias("unit"), diff.cast("double").alias("d"))
    return rows.where("d is not null and not isnan(d) and unit is not null").groupBy("unit", "d").agg(F.count("*").alias("n"))


def _statistics(weighted: DataFrame, by: list[str]) -> DataFrame:
    """share of differences above 0 and their median; weighted: by, d, n."""
    share = F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)) / F.sum("n")
    return weighted.groupBy(*by).agg(share.alias("share"), F.percentile("d", F.lit(0.5), F.col("n")).alias("median"))


def paired_readout(df: DataFrame, diff: Column, unit: str, units: int, draws: int = 200, seed: int = 0) -> DataFrame:
    """One row: n, clusters, share and median of diff with their intervals, and passes: both lower bounds are above a half and 0.

    unit: a cluster's number, 0 to ``units`` - 1; a draw chooses so many with replacement (those without rows add nothing).
    Differences are counted by value and cluster first, so draws weigh counts. An empty table has n = 0 and does not pass.
    """
    levels = written(_levels(df, diff, unit), "differences")
    weights = F.broadcast(resample_weights(df.sparkSession.range(units).select(F.col("id").alias("unit")), units, draws, seed))  # at most units * draws
    drawn = _statistics(levels.join(weights, "unit").select("draw", "d", (F.col("n") * F.col("weight")).alias("n")), ["draw"])
    ends = drawn.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{e}") for c in ("share", "median") for e, q in (("low", 0.025), ("high", 0.975))])
    one = levels.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_distinct("unit").alias("clusters"))
    whole = _statistics(levels, [])
    out = one.join(F.broadcast(whole)).join(F.broadcast(ends))  # each is one row
    return out.withColumn("passes", F.coalesce((F.col("share_low") > 0.5) & (F.col("median_low") > 0), F.lit(False)))


def sign_flips(df: DataFrame, diff: Column, unit: str, units: int, flips: int = 20, draws: int = 40, most: float = 0.05, seed: int = 0) -> DataFrame:
    """One row: flips, passes, share and holds: how often the readout passes when each cluster's differences change sign by a coin, at most ``most``."""
    levels = written(_levels(df, diff, unit), "differences").withColumn("flip", F.explode(F.sequence(F.lit(0), F.lit(flips - 1))))
    turned = F.when(draw(F.col("unit"), F.col("flip").cast("long"), seed) % 2 == 0, F.col("d")).otherwise(-F.col("d"))
    weights = F.broadcast(resample_weights(df.sparkSession.range(units).select(F.col("id").alias("unit")), units, draws, seed + 1))  # at most units * draws
    drawn = _statistics(levels.withColumn("d", turned).join(weights, "unit").select("flip", "draw", "d", (F.col("n") * F.col("weight")).alias("n")), ["flip", "draw"])
    low = drawn.groupBy("flip").agg(*[F.percentile(c, F.lit(0.025)).alias(c) for c in ("share", "median")])
    out = low.agg(F.count_if((F.col("share") > 0.5) & (F.col("median") > 0)).alias("passes"))
    return out.select(F.lit(flips).alias("flips"), "passes", (F.col("passes") / flips).alias("share"), (F.col("passes") / flips <= most).alias("holds"))


def degradation(df: DataFrame, full: Column, damaged: Column) -> DataFrame:
    """One row: median of the full and of the damaged difference, and holds: the damage leaves at most half of the lead (null where there is no lead).

    full: the compared side less the other; damaged: the same after a stated damage to the compared side.
    """
    rows = df.select(full.cast("double").alias("d"), damaged.cast("double").alias("e"))
    out = rows.agg(F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("e", F.lit(0.5)).alias("median_lead"))
    return out.withColumn("holds", F.when(F.col("median") > 0, F.col("median_lead") <= F.col("median") / 2))


def border_share(df: DataFrame, at_border: Column, most: float = 0.1) -> DataFrame:
    """One row: n, at_border, share and holds: at most ``most`` of the best shifts lie on the border of their search (null for no rows)."""
    one = df.agg(F.count("*").alias("n"), F.count_if(at_border).alias("at_border"))
    share = F.when(F.col("n") > 0, F.col("at_border") / F.col("n"))
    return one.select("n", "at_border", share.alias("share"), (share <= most).alias("holds"))
