"""Exact histogram AUCs, curves, resampling statistics, calibration and summary aggregates.

Scores are first counted per (group, level, class) with partial aggregation; only those histograms are ordered. The
running sums over levels are taken in two steps (within a bucket of levels, and over buckets), so no task has to hold
all levels of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .graph import written
from .resampling import draw

BUCKETS = 256


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def same(names: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names], F.lit(True))


def running(hist: DataFrame, by: list[str], level: str, values: list[str], descending: bool = False) -> DataFrame:
    """hist with, for each value v, v_before: its sum over the group's earlier levels. level: numeric, once per group."""
    span = hist.groupBy(*by).agg(F.min(level).cast("double").alias("_low"), F.max(level).cast("double").alias("_high"))
    joined = hist.join(F.broadcast(span) if not by else span, same(by, hist, span)).select(hist["*"], "_low", "_high")  # without groups span is one row
    part = F.least(F.floor((F.col(level) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    cut = joined.withColumn("_bucket", -part if descending else part).drop("_low", "_high")
    sums = cut.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    over = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "_bucket", *[F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_{v}") for v in values])  # at most BUCKETS rows a group
    keys = [*by, "_bucket"]
    both = cut.join(sums, same(keys, cut, sums)).select(cut["*"], *[sums[f"_{v}"] for v in values])
    inside = W.partitionBy(*keys).orderBy(F.col(level).desc() if descending else F.col(level)).rowsBetween(W.unboundedPreceding, -1)
    return both.select(*hist.columns, *[(F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values])


def histogram(df: DataFrame, score: str, label: str, by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """by, level, a (label 1) and b (label 0) counts."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*by, F.col(score).alias("level")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("a"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("b"))


def auc_of(hist: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, n_pos, n_neg, auc (ties half; null where a class is absent) of histograms."""
    by = list(by)
    run = running(hist, by, "level", ["b"])
    wins = F.sum(F.col("a").cast("double") * F.col("b_before") + F.lit(0.5) * F.col("a") * F.col("b"))
    out = run.groupBy(*by).agg(F.sum("a").alias("n_pos"), F.sum("b").alias("n_neg"), wins.alias("_w"))
    return out.select(*by, "n_pos", "n_neg", r6(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos").cast("double") * F.col("n_neg")))).alias("auc"))


def auc(df: DataFrame, score: str, label: str, by: list[str] = ()) -> DataFrame:
    """Mann-Whitney AUC by score histogram."""
    return auc_of(histogram(df, score, label, list(by)), by)


def curve(hist: DataFrame, by: list[str]) -> DataFrame:
    """by, level, tp, fp at each threshold (level and above), with the group's totals P and N."""
    run = running(hist, by, "level", ["a", "b"], descending=True)
    totals = hist.groupBy(*by).agg(F.sum("a").cast("double").alias("P"), F.sum("b").cast("double").alias("N"))
    at = run.join(totals, same(by, run, totals)).select(*[run[c] for c in run.columns], "P", "N").where("P > 0 and N > 0")
    return at.select(*by, "level", "a", "b", (F.col("a_before") + F.col("a")).alias("tp"), (F.col("b_before") + F.col("b")).alias("fp"), "a_before", "b_before", "P", "N")


def curve_stats(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """AP, tie share, AUC with ties as losses and wins, TPR at FPR 1, 5, 10 %, best F1 and Youden thresholds."""
    at = curve(histogram(df, score, label, by), by)
    prec, tpr, fpr = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("P"), F.col("fp") / F.col("N")
    at = at.withColumns({"prec": prec, "tpr": tpr, "fpr": fpr})
    f1 = F.when(F.col("tp") > 0, F.round(2 * F.col("prec") * F.col("tpr") / (F.col("prec") + F.col("tpr")), 9)).otherwise(0.0)
    best = lambda value: F.max(F.struct(value.alias("v"), F.col("level").alias("level")))  # noqa: E731  ties: the higher threshold
    tie = F.sum(F.col("a").cast("double") * F.col("b")) / F.first(F.col("P") * F.col("N"))
    area = F.sum((F.col("fp") - F.col("b_before")) * (F.col("tp") + F.col("a_before")) / 2.0) / F.first(F.col("P") * F.col("N"))
    out = at.groupBy(*by).agg(
        area.alias("auc"), F.sum(F.col("a") / F.col("P") * F.col("prec")).alias("ap"), tie.alias("tied_pair_share"), F.count("*").alias("levels_used"),
        *[F.coalesce(F.max(F.when(F.col("fpr") <= f + 1e-12, F.col("tpr"))), F.lit(0.0)).alias(f"tpr_at_{n}") for f, n in ((0.01, "01"), (0.05, "05"), (0.1, "10"))],
        best(f1).alias("f1"), best(F.round(F.col("tpr") - F.col("fpr"), 9)).alias("j"),
    )
    out = out.withColumns({"auc_ties_lose": F.col("auc") - F.col("tied_pair_share") / 2, "auc_ties_win": F.col("auc") + F.col("tied_pair_share") / 2})
    return out.select(*by, *[r6(c).alias(c) for c in ("auc", "ap", "tied_pair_share", "auc_ties_lose", "auc_ties_win", "tpr_at_01", "tpr_at_05", "tpr_at_10")], "levels_used", r6("f1.v").alias("best_f1"), F.col("f1.level").alias("f1_level"), r6("j.v").alias("youden"), F.col("j.level").alias("youden_level"))


def select_scored(px: DataFrame, size: int, inner: int = 0, keep_zero: bool = False) -> DataFrame:
    """Supervised pixels inside the edge margin of squares of this size, one above the other, without exact zeros unless kept."""
    edge = (F.col("y") % size).between(inner, size - 1 - inner) & F.col("x").between(inner, size - 1 - inner)
    return px.where((F.col("sup") == 1) & edge & (F.lit(keep_zero) | (F.col("v") != 0)))


def tile_auc(px: DataFrame, tile: int, min_px: int) -> DataFrame:
    """AUC of each tile of a map with at least min_px pixels of both classes."""
    cut = px.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    return auc(cut, "v", "ink", ["map_id", "ty", "tx"]).where(F.least("n_pos", "n_neg") >= min_px)


def window_auc(px: DataFrame, tile: int, tiles: int, size: int) -> DataFrame:
    """AUC of sliding windows of tiles x tiles tiles inside squares of this size: tile histograms are summed, pixels are counted once."""
    cut = px.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    hist, side = histogram(cut, "v", "ink", ["map_id", "ty", "tx"]), size // tile

    def spread(c: str):
        first = F.col(c) - F.col(c) % side  # of the square's tiles
        return F.explode(F.sequence(F.greatest(F.col(c) - tiles + 1, first), F.least(F.col(c), first + side - tiles)))

    hist = hist.withColumn("wy", spread("ty")).withColumn("wx", spread("tx")).groupBy("map_id", "wy", "wx", "level").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return auc_of(hist, ["map_id", "wy", "wx"])


def bootstrap_auc(hist: DataFrame, weights: DataFrame, draws_by: list[str] = ()) -> DataFrame:
    """AUC of each draw. hist: unit, level, a, b (and draws_by); weights: draw, unit, weight."""
    w = hist.join(weights, "unit").groupBy(*draws_by, "draw", "level").agg(F.sum(F.col("a") * F.col("weight")).alias("a"), F.sum(F.col("b") * F.col("weight")).alias("b"))
    return auc_of(w, [*draws_by, "draw"])


def interval(df: DataFrame, value: str, by: list[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """n, mean and exact percentile bounds of a column of draws; draws without a value are dropped."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean"), r6(F.percentile(value, F.lit(low))).alias("low"), r6(F.percentile(value, F.lit(high))).alias("high"))


def mid_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Average rank (1..n) of each row in its group, by counts of values: rows are never sorted."""
    hist = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = running(hist, by, value, ["_n"]).select(*by, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, same([*by, value], df, ranks)).select(df["*"], ranks[name])


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p, d = k / n, 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - half) / d, (p + z * z / (2 * n) + half) / d


def reliability(df: DataFrame, prob: str, label: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """Rows per equal-width bin of a probability: count, mean probability, share of label 1."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"))


def calibration(df: DataFrame, prob: str, label: str, bins: int = 10, by: list[str] = ()) -> DataFrame:
    """Expected calibration error and Brier score, from sums per bin."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    sums = df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.sum(prob).alias("p"), F.sum(F.col(label).cast("double")).alias("k"), F.sum((F.col(prob) - F.col(label)) ** 2).alias("q"))
    return sums.groupBy(*by).agg(r6(F.sum(F.abs(F.col("p") - F.col("k"))) / F.sum("n")).alias("ece"), r6(F.sum("q") / F.sum("n")).alias("brier"), F.sum("n").alias("n"))


def multiset_digest(df: DataFrame) -> DataFrame:
    """rows and order-free sums of four 32-bit limbs of each row's SHA-256: equal for equal multisets of rows."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    h = df.select(F.sha2(text, 256).alias("h"))
    limb = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return h.agg(F.count("*").alias("rows"), *[F.coalesce(limb(i), F.lit("0")).alias(f"limb{i}") for i in range(4)])


def hash_rank(df: DataFrame, key: str, by: list[str], seed: int, number: Column | None = None) -> DataFrame:
    """df with rank_hash: the place of each row in its group in hash order (ties by key)."""
    h = draw(F.col(key).cast("long"), F.lit(0).cast("long") if number is None else number.cast("long"), seed)
    return df.withColumn("_h", h).withColumn("rank_hash", F.row_number().over(W.partitionBy(*by).orderBy("_h", key))).drop("_h")


#: Buckets of the hashes below 2**31 in which :func:`first_by_hash` counts.
BUCKETS = 4096
#: So many buckets are broadcast.
MOST_EDGES = 100_000


def first_by_hash(df: DataFrame, key: str, by: list[str], seed: int, n: int, number: Column | None = None) -> DataFrame:
    """The rows of :func:`hash_rank` up to place n. Rows are counted by bucket of their hash first, and only those up to the bucket that holds place n are ordered."""
    h = draw(F.col(key).cast("long"), F.lit(0).cast("long") if number is None else number.cast("long"), seed)
    rows = df.withColumn("_b", F.coalesce(F.floor(h / (2**31 // BUCKETS)).cast("int"), F.lit(-1)))  # nulls are first
    upto = F.sum("_n").over(W.partitionBy(*by).orderBy("_b"))  # a group's buckets
    counts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n")).withColumn("_upto", upto)
    edge = written(counts.where(F.col("_upto") - F.col("_n") < n).select(*by, "_b"), "edge")
    few = edge.count() <= MOST_EDGES
    return hash_rank(rows.join(F.broadcast(edge) if few else edge, [*by, "_b"]).drop("_b"), key, by, seed, number).where(F.col("rank_hash") <= n)


def tally(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))


def people_by_works(items: DataFrame, works: DataFrame, key: str, who: str, score: str) -> DataFrame:
    """who, total, works, items: each work (component of similar items of a person) is worth its best score. works: node, component."""
    best = items.join(works, items[key] == works["node"]).groupBy(who, "component").agg(F.max(score).alias("best"), F.count("*").alias("items"))
    return best.groupBy(who).agg(F.sum("best").alias("total"), F.count("*").alias("works"), F.sum("items").alias("items"))


def mixture_weights(df: DataFrame, component: str, shares: dict[str, float]) -> DataFrame:
    """component, n, weight: each sample's weight, so that a component's samples together carry its share; components without a share get 0."""
    total = sum(shares.values())
    if total <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must not be negative, and not all zero")
    counts = df.groupBy(component).agg(F.count("*").alias("n"))
    asked = df.sparkSession.createDataFrame([(k, float(v) / total) for k, v in shares.items()], f"{component} string, _share double")
    both = F.broadcast(asked).join(counts, component, "full_outer")  # the named shares
    bad = (F.col("_share") > 0) & F.col("n").isNull()
    weight = F.when(bad, F.raise_error(F.concat(F.lit("no samples of "), component)).cast("double")).when(F.col("_share") > 0, F.col("_share") / F.col("n")).otherwise(0.0)
    return both.select(component, F.coalesce("n", F.lit(0)).cast("long").alias("n"), weight.alias("weight"))
