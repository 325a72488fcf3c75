"""Queries of the statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import resampling as rs
from ..operators import stats as st
from ..operators.graph import written
from ..operators.stats import r6
from .registry import query

AUC = """SELECT {by}, n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN w / (CAST(n_pos AS DOUBLE) * n_neg) END, 6) AS auc FROM (
 SELECT {by}, CAST(sum(a) AS BIGINT) AS n_pos, CAST(sum(b) AS BIGINT) AS n_neg, sum(CAST(a AS DOUBLE) * below + CAST(0.5 AS DOUBLE) * a * b) AS w FROM (
  SELECT *, coalesce(sum(b) OVER (PARTITION BY {by} ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {hist}) GROUP BY {by})"""
DRAW = "(((CAST({slot} AS BIGINT) * 1103515245 + CAST({number} AS BIGINT) * 12345 + {seed}) % 2147483647 * 48271) % 2147483647)"


def _draw(slot: str, number: str, seed: int = 0) -> str:
    return DRAW.format(slot=slot, number=number, seed=seed * 69069 + 7919)


@query("a1_auc", views="scored_docs", sql=f"""
WITH g AS (SELECT 'all' AS part, score, label FROM scored_docs UNION ALL SELECT lang, score, label FROM scored_docs),
h AS (SELECT part, score AS level, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS b FROM g GROUP BY 1, 2)
{AUC.format(by="part", hist="h")}""")
def a1(t):
    docs = t.scored_docs.select("lang", "score", "label")
    parts = docs.select(F.lit("all").alias("part"), "score", "label").unionByName(docs.select(F.col("lang").alias("part"), "score", "label"))
    return st.auc(parts, "score", "label", ["part"])


@query("a2_curve_stats", views="scored_docs", sql="""
WITH h AS (SELECT lang, score AS level, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)::DOUBLE AS b FROM scored_docs GROUP BY 1, 2),
c AS (SELECT *, sum(a) OVER (PARTITION BY lang ORDER BY level DESC) AS tp, sum(b) OVER (PARTITION BY lang ORDER BY level DESC) AS fp, sum(a) OVER (PARTITION BY lang) AS p, sum(b) OVER (PARTITION BY lang) AS n FROM h),
d AS (SELECT *, tp / (tp + fp) AS prec, tp / p AS tpr, fp / n AS fpr, CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p), 9) ELSE 0 END AS f1, round(tp / p - fp / n, 9) AS j FROM c WHERE p > 0 AND n > 0),
s AS (SELECT lang, sum(b * (tp + tp - a) / 2) / (first(p) * first(n)) AS auc, sum(a / p * prec) AS ap, sum(a * b) / (first(p) * first(n)) AS tie, count(*) AS levels_used,
 coalesce(max(tpr) FILTER (fpr <= 0.01 + 1e-12), 0) AS t01, coalesce(max(tpr) FILTER (fpr <= 0.05 + 1e-12), 0) AS t05, coalesce(max(tpr) FILTER (fpr <= 0.1 + 1e-12), 0) AS t10, max(f1) AS f1, max(j) AS j FROM d GROUP BY 1)
SELECT lang, round(auc, 6) AS auc, round(ap, 6) AS ap, round(tie, 6) AS tied_pair_share, round(auc - tie / 2, 6) AS auc_ties_lose, round(auc + tie / 2, 6) AS auc_ties_win,
 round(t01, 6) AS tpr_at_01, round(t05, 6) AS tpr_at_05, round(t10, 6) AS tpr_at_10, levels_used, round(s.f1, 6) AS best_f1, (SELECT max(level) FROM d WHERE d.lang = s.lang AND d.f1 = s.f1) AS f1_level, round(s.j, 6) AS youden, (SELECT max(level) FROM d WHERE d.lang = s.lang AND d.j = s.j) AS youden_level FROM s""")
def a2(t):
    return st.curve_stats(t.scored_docs, "score", "label", ["lang"])


_SCORED = "sc AS (SELECT * FROM px WHERE sup = 1 AND v <> 0 AND y % 64 BETWEEN 2 AND 61 AND x BETWEEN 2 AND 61)"


@query("p5_select_scored", views="px", sql="""
SELECT map_id, count(*) FILTER (v <> 0) AS n_scored, count(*) FILTER (v = 0) AS n_zero, count(*) FILTER (v <> 0 AND ink = 1) AS n_ink FROM px WHERE sup = 1 AND y % 64 BETWEEN 2 AND 61 AND x BETWEEN 2 AND 61 GROUP BY 1""")
def p5(t):
    kept = st.select_scored(t.px, 64, inner=2, keep_zero=True)
    return kept.groupBy("map_id").agg(F.count_if(F.col("v") != 0).alias("n_scored"), F.count_if(F.col("v") == 0).alias("n_zero"), F.count_if((F.col("v") != 0) & (F.col("ink") == 1)).alias("n_ink"))


@query("a3_tile_auc", views="px", sql=f"""
WITH {_SCORED}, h AS (SELECT map_id, y // 16 AS ty, x // 16 AS tx, v AS level, sum(ink) AS a, sum(1 - ink) AS b FROM sc GROUP BY 1, 2, 3, 4),
r AS ({AUC.format(by="map_id, ty, tx", hist="h")}), k AS (SELECT * FROM r WHERE least(n_pos, n_neg) >= 5)
SELECT map_id, count(*) AS tiles, round(min(auc), 6) AS low, round(quantile_cont(auc, 0.25), 6) AS q25, round(quantile_cont(auc, 0.5), 6) AS median, round(quantile_cont(auc, 0.75), 6) AS q75, round(max(auc), 6) AS high, count(*) FILTER (auc <= 0.5) AS at_or_below_half FROM k GROUP BY 1""")
def a3(t):
    tiles = st.tile_auc(st.select_scored(t.px, 64, 2), 16, 5)
    q = lambda p: r6(F.percentile("auc", F.lit(p)))
    return tiles.groupBy("map_id").agg(F.count("*").alias("tiles"), r6(F.min("auc")).alias("low"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), r6(F.max("auc")).alias("high"), F.count_if(F.col("auc") <= 0.5).alias("at_or_below_half"))


@query("a4_window_auc", views="px", sql=f"""
WITH {_SCORED}, c AS (SELECT sc.* EXCLUDE (y), y // 64 * 8 + w AS wy, wx FROM sc, (SELECT unnest(range(0, 6)) AS w), (SELECT unnest(range(0, 6)) AS wx) WHERE y // 8 % 8 BETWEEN w AND w + 2 AND x // 8 BETWEEN wx AND wx + 2),
h AS (SELECT map_id, wy, wx, v AS level, sum(ink) AS a, sum(1 - ink) AS b FROM c GROUP BY 1, 2, 3, 4)
{AUC.format(by="map_id, wy, wx", hist="h")}""")
def a4(t):
    return st.window_auc(st.select_scored(t.px, 64, 2), 8, 3, 64)


def _blocks(t):
    px = st.select_scored(t.px, 64, 2).withColumn("unit", (F.floor(F.col("y") / 16) % 4 * 4 + F.floor(F.col("x") / 16)).cast("long"))
    return st.histogram(px, "v", "ink", ["map_id", "unit"]), rs.resample_weights(t.spark.range(16).select(F.col("id").alias("unit")), 16, 40, seed=1)


_BOOT = f"""{_SCORED}, w AS (SELECT d AS draw, {_draw("s", "d", 1)} % 16 AS unit, count(*) AS weight FROM (SELECT unnest(range(0, 16)) AS s), (SELECT unnest(range(0, 40)) AS d) GROUP BY 1, 2),
u AS (SELECT map_id, (y // 16 % 4) * 4 + x // 16 AS unit, v AS level, sum(ink) AS a, sum(1 - ink) AS b FROM sc GROUP BY 1, 2, 3),
h AS (SELECT map_id, draw, level, sum(a * weight) AS a, sum(b * weight) AS b FROM u JOIN w USING (unit) GROUP BY 1, 2, 3),
r AS ({AUC.format(by="map_id, draw", hist="h")})"""


@query("a5_block_bootstrap", views="px", sql=f"""WITH {_BOOT}
SELECT map_id, count(*) AS n, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM r WHERE auc IS NOT NULL GROUP BY 1""")
def a5(t):
    hist, weights = _blocks(t)
    return st.interval(st.bootstrap_auc(hist, weights, ["map_id"]), "auc", ["map_id"])


@query("a7_arm_bootstrap", views="px", sql=f"""WITH {_BOOT},
d AS (SELECT x.draw, x.auc - y.auc AS diff FROM r x JOIN r y ON x.draw = y.draw AND x.map_id = 0 AND y.map_id = 1)
SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high, count(*) FILTER (diff <= 0) AS not_ahead FROM d""")
def a7(t):
    hist, weights = _blocks(t)
    draws = st.bootstrap_auc(hist, weights, ["map_id"])
    x, y = draws.where("map_id = 0").select("draw", F.col("auc").alias("x")), draws.where("map_id = 1").select("draw", F.col("auc").alias("y"))
    diff = x.join(y, "draw").select((F.col("x") - F.col("y")).alias("diff"))
    return diff.agg(F.count("diff").alias("n"), r6(F.avg("diff")).alias("mean"), r6(F.percentile("diff", F.lit(0.025))).alias("low"), r6(F.percentile("diff", F.lit(0.975))).alias("high"), F.count_if(F.col("diff") <= 0).alias("not_ahead"))


@query("a6_cluster_bootstrap", views="scored_docs", sql=f"""
WITH c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS unit, count(*) AS n, sum(score)::BIGINT AS s FROM scored_docs GROUP BY 1), k AS (SELECT count(*) AS k FROM c),
w AS (SELECT d, {_draw("unit", "d", 2)} % k AS unit, count(*) AS weight FROM c, k, (SELECT unnest(range(0, 50)) AS d) GROUP BY 1, 2),
m AS (SELECT d, sum(s * weight)::DOUBLE / sum(n * weight) AS mean FROM w JOIN c USING (unit) GROUP BY 1)
SELECT count(*) AS n, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def a6(t):
    sums = t.scored_docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    units, k = rs.dense_units(sums, "source")
    weights = rs.resample_weights(units, k, 50, seed=2)
    means = weights.join(units, "unit").join(sums, "source").groupBy("draw").agg((F.sum(F.col("s") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("mean"))
    return st.interval(means, "mean")


@query("a8_control_gap", views="px", sql=f"""
WITH p AS (SELECT a.y, a.x, a.ink, a.v AS map_v, b.v AS ctl_v FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.map_id = 0 AND b.map_id = 1 WHERE a.sup = 1 AND a.v <> 0 AND b.v <> 0),
g AS (SELECT 'map' AS arm, map_v AS level, ink FROM p UNION ALL SELECT 'control', ctl_v, ink FROM p), h AS (SELECT arm, level, sum(ink) AS a, sum(1 - ink) AS b FROM g GROUP BY 1, 2), r AS ({AUC.format(by="arm", hist="h")})
SELECT m.n_pos, m.n_neg, m.auc AS map_auc, c.auc AS control_auc, round(m.auc - c.auc, 6) AS gap, (SELECT count(DISTINCT ctl_v) FROM p) = 1 AS control_constant FROM r m, r c WHERE m.arm = 'map' AND c.arm = 'control'""")
def a8(t):
    a = t.px.where("map_id = 0 and sup = 1 and v <> 0").select("y", "x", "ink", F.col("v").alias("map"))
    b = t.px.where("map_id = 1 and v <> 0").select("y", "x", F.col("v").alias("control"))
    both = a.join(b, ["y", "x"]).select("ink", F.explode(F.create_map(F.lit("map"), "map", F.lit("control"), "control")).alias("arm", "v"))
    hist = st.histogram(both, "v", "ink", ["arm"])
    levels = hist.where("arm = 'control'").agg(F.count("*").alias("levels"))
    wide = st.auc_of(hist, ["arm"]).groupBy("n_pos", "n_neg").pivot("arm", ["map", "control"]).agg(F.first("auc"))
    return wide.join(F.broadcast(levels)).select("n_pos", "n_neg", F.col("map").alias("map_auc"), F.col("control").alias("control_auc"), r6(F.col("map") - F.col("control")).alias("gap"), (F.col("levels") == 1).alias("control_constant"))  # levels is one row


@query("a9_pool_reports", views="scored_docs", sql=f"""
WITH h AS (SELECT source, score AS level, sum(label)::BIGINT AS a, sum(1 - label)::BIGINT AS b FROM scored_docs GROUP BY 1, 2), r AS ({AUC.format(by="source", hist="h")})
SELECT count(*) AS segments, count(auc) AS scored, round(avg(auc), 6) AS mean, round(min(auc), 6) AS low, round(max(auc), 6) AS high, round(sum(auc * n_pos) / sum(n_pos) FILTER (auc IS NOT NULL), 6) AS weighted_mean, count(*) FILTER (auc > 0.5) AS ahead FROM r""")
def a9(t):
    r = st.auc(t.scored_docs, "score", "label", ["source"])
    return r.agg(F.count("*").alias("segments"), F.count("auc").alias("scored"), r6(F.avg("auc")).alias("mean"), r6(F.min("auc")).alias("low"), r6(F.max("auc")).alias("high"), r6(F.sum(F.col("auc") * F.col("n_pos")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("n_pos")))).alias("weighted_mean"), F.count_if(F.col("auc") > 0.5).alias("ahead"))


def _pair(t, a: int = 0, b: int = 1):
    return t.px.where(F.col("map_id") == a).select("y", "x", "ink", "sup", F.col("v").cast("double").alias("p")).join(t.px.where(F.col("map_id") == b).select("y", "x", F.col("v").cast("double").alias("q")), ["y", "x"])


_PAIR = "p AS (SELECT a.y, a.x, a.ink, a.sup, CAST(a.v AS DOUBLE) AS p, CAST(b.v AS DOUBLE) AS q FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.map_id = 0 AND b.map_id = 1)"


@query("a10_compare_maps", views="px", sql=f"""WITH {_PAIR}
SELECT count(*) AS n, max(abs(p - q)) AS max_diff, round(avg(abs(p - q)), 6) AS mean_diff, count(*) FILTER (abs(p - q) > 64) AS over, round(count(*) FILTER (abs(p - q) > 64)::DOUBLE / count(*), 6) AS over_share, round(corr(p, q), 6) AS pearson,
 CASE WHEN count(*) FILTER (abs(p - q) > 64) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM p""")
def a10(t):
    d = F.abs(F.col("p") - F.col("q"))
    over = F.count_if(d > 64)
    return _pair(t).agg(F.count("*").alias("n"), F.max(d).alias("max_diff"), r6(F.avg(d)).alias("mean_diff"), over.alias("over"), r6(over / F.count("*")).alias("over_share"), r6(F.corr("p", "q")).alias("pearson"), F.when(over == 0, "PASS").otherwise("FAIL").alias("verdict"))


@query("a11_correlations", views="px", sql=f"""WITH {_PAIR}, r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0::DOUBLE AS rq FROM p)
SELECT round(corr(p, q), 6) AS pearson, round(corr(rp, rq), 6) AS spearman, count(*) AS n FROM r""")
def a11(t):
    ranked = st.mid_rank(st.mid_rank(_pair(t), "p", [], "rp"), "q", [], "rq")
    return ranked.agg(r6(F.corr("p", "q")).alias("pearson"), r6(F.corr("rp", "rq")).alias("spearman"), F.count("*").alias("n"))


@query("a13_tally", views="feed", sql="SELECT source AS value, count(*) AS n FROM feed GROUP BY 1")
def a13(t):
    return st.tally(t.feed, "source")


@query("a14_overview", views="feed", sql="""
SELECT topic, count(*) FILTER (source = 'click') AS click, count(*) FILTER (source = 'view') AS view, count(*) FILTER (source = 'purchase') AS purchase, count(*) AS n, count(*) FILTER (score >= 50) AS high FROM feed GROUP BY 1""")
def a14(t):
    n = lambda s: F.count_if(F.col("source") == s).alias(s)
    return t.feed.groupBy("topic").agg(n("click"), n("view"), n("purchase"), F.count("*").alias("n"), F.count_if(F.col("score") >= 50).alias("high"))


@query("a14_score_bins", views="feed", sql="SELECT score // 5 AS bin, source, count(*) AS n, grouping(source)::INT AS of_all FROM feed GROUP BY GROUPING SETS ((score // 5), (score // 5, source))")
def a14b(t):
    binned = t.feed.select(F.floor(F.col("score") / 5).cast("int").alias("bin"), "source")
    return binned.rollup("bin", "source").agg(F.count("*").alias("n"), F.grouping("source").cast("int").alias("of_all")).where(F.col("bin").isNotNull())


@query("a16_summarize_finest", sql="""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_size, p_partkey) AS rn FROM part)
SELECT p_brand AS scroll, count(DISTINCT p_type) AS segments, round(sum(p_retailprice) FILTER (rn = 1), 4) AS area, count(*) AS meshes FROM f GROUP BY 1""")
def a16(t):
    rn = F.row_number().over(W.partitionBy("p_brand", "p_type").orderBy("p_size", "p_partkey"))
    return t.part.withColumn("rn", rn).groupBy(F.col("p_brand").alias("scroll")).agg(F.countDistinct("p_type").alias("segments"), F.round(F.sum(F.when(F.col("rn") == 1, F.col("p_retailprice"))), 4).alias("area"), F.count("*").alias("meshes"))


@query("a17_catalog_rollup", sql="""
SELECT r_name, n_name, count(*) AS n, round(sum(s_acctbal), 4) AS total, grouping(n_name)::INT AS over_nations FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def a17(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 4).alias("total"), F.grouping("n_name").cast("int").alias("over_nations"))


@query("a18_leaderboard", sql="""
WITH g AS (SELECT l_suppkey AS reader, l_returnflag AS segment, avg(l_discount) AS gap FROM lineitem GROUP BY 1, 2),
m AS (SELECT reader, count(*) AS segments, avg(gap) AS mean_gap, min(gap) >= 0.04 AS clears FROM g GROUP BY 1)
SELECT reader, round(mean_gap, 6) AS mean_gap, clears, rank() OVER (ORDER BY round(mean_gap, 6) DESC) AS place, round(mean_gap, 6) - lead(round(mean_gap, 6)) OVER (ORDER BY round(mean_gap, 6) DESC, reader) >= 0.0005 AS clear_win FROM m WHERE segments = 3 ORDER BY round(mean_gap, 6) DESC, reader LIMIT 10""")
def a18(t):
    gaps = t.lineitem.groupBy(F.col("l_suppkey").alias("reader"), "l_returnflag").agg(F.avg("l_discount").alias("gap"))
    means = gaps.groupBy("reader").agg(F.count("*").alias("segments"), r6(F.avg("gap")).alias("mean_gap"), (F.min("gap") >= 0.04).alias("clears")).where("segments = 3")
    top = means.orderBy(F.desc("mean_gap"), "reader").limit(11)  # the listing, and who follows its last row
    over, order = W.orderBy(F.desc("mean_gap")), W.orderBy(F.desc("mean_gap"), "reader")
    out = top.select("reader", "mean_gap", "clears", F.rank().over(over).cast("long").alias("place"), (F.col("mean_gap") - F.lead("mean_gap").over(order) >= 0.0005).alias("clear_win"))
    return out.orderBy("place", "reader").limit(10)


@query("a19_threshold_metrics", views="px", sql="""
SELECT map_id, t AS threshold, count(*) FILTER (v >= t AND ink = 1) AS tp, count(*) FILTER (v >= t AND ink = 0) AS fp, count(*) FILTER (v < t AND ink = 1) AS fn, count(*) FILTER (v < t AND ink = 0) AS tn,
 round(count(*) FILTER (v >= t AND ink = 1)::DOUBLE / nullif(count(*) FILTER (v >= t), 0), 6) AS precision FROM px, (SELECT unnest([64, 128, 192]) AS t) WHERE sup = 1 GROUP BY 1, 2""")
def a19(t):
    px = t.px.where("sup = 1").withColumn("threshold", F.explode(F.array(*map(F.lit, (64, 128, 192)))))
    called, ink = F.col("v") >= F.col("threshold"), F.col("ink") == 1
    return px.groupBy("map_id", "threshold").agg(F.count_if(called & ink).alias("tp"), F.count_if(called & ~ink).alias("fp"), F.count_if(~called & ink).alias("fn"), F.count_if(~called & ~ink).alias("tn"), r6(F.try_divide(F.count_if(called & ink), F.count_if(called))).alias("precision"))


@query("a20_calibration", views="px", sql="""
WITH p AS (SELECT map_id, v / CAST(255 AS DOUBLE) AS pr, ink FROM px WHERE sup = 1), s AS (SELECT map_id, least(floor(pr * 10), 9) AS bin, count(*) AS n, sum(pr) AS p, sum(ink) AS k, sum((pr - ink) * (pr - ink)) AS q FROM p GROUP BY 1, 2)
SELECT map_id, round(sum(abs(p - k)) / sum(n), 6) AS ece, round(sum(q) / sum(n), 6) AS brier, sum(n)::BIGINT AS n FROM s GROUP BY 1""")
def a20(t):
    return st.calibration(t.px.where("sup = 1").withColumn("p", F.col("v") / 255.0), "p", "ink", by=["map_id"])


@query("a20_reliability", views="px", sql="""
SELECT map_id, least(floor(v / CAST(255 AS DOUBLE) * 10), 9)::INT AS bin, count(*) AS n, round(avg(v / CAST(255 AS DOUBLE)), 6) AS mean_p, round(avg(ink), 6) AS share FROM px WHERE sup = 1 GROUP BY 1, 2""")
def a20b(t):
    out = st.reliability(t.px.where("sup = 1").withColumn("p", F.col("v") / 255.0), "p", "ink", by=["map_id"])
    return out.select("map_id", "bin", "n", r6("mean_p").alias("mean_p"), r6("share").alias("share"))


@query("a21_ap_at_prevalence", views="scored_docs", sql=f"""
WITH pos AS (SELECT doc_id, score, label, rep, row_number() OVER (PARTITION BY rep ORDER BY {_draw("doc_id", "rep", 3)}, doc_id) AS rk FROM scored_docs, (SELECT unnest(range(0, 5)) AS rep) WHERE label = 1),
n AS (SELECT count(*) FILTER (label = 0) AS neg FROM scored_docs), u AS (SELECT rep, score AS level, 1 AS label FROM pos, n WHERE rk <= floor(neg * CAST(0.25 AS DOUBLE)) UNION ALL SELECT rep, score, 0 FROM scored_docs, (SELECT unnest(range(0, 5)) AS rep) WHERE label = 0),
h AS (SELECT rep, level, sum(label)::DOUBLE AS a, sum(1 - label)::DOUBLE AS b FROM u GROUP BY 1, 2),
c AS (SELECT *, sum(a) OVER (PARTITION BY rep ORDER BY level DESC) AS tp, sum(b) OVER (PARTITION BY rep ORDER BY level DESC) AS fp, sum(a) OVER (PARTITION BY rep) AS p FROM h)
SELECT rep, round(sum(a / p * tp / (tp + fp)), 6) AS ap FROM c GROUP BY 1""")
def a21(t):
    docs = t.scored_docs.select("doc_id", "score", "label").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4))))
    neg = docs.where("label = 0")
    room = neg.where("rep = 0").agg(F.floor(F.count("*") * 0.25).alias("room"))
    pos = st.hash_rank(docs.where("label = 1"), "doc_id", ["rep"], 3, F.col("rep")).join(F.broadcast(room)).where("rank_hash <= room")  # room is one row
    both = pos.select("rep", "score", "label").unionByName(neg.select("rep", "score", "label"))
    at = st.curve(st.histogram(both, "score", "label", ["rep"]), ["rep"])
    return at.groupBy("rep").agg(r6(F.sum(F.col("a") / F.col("P") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("ap"))


@query("a22_wilson", views="scored_docs", sql="""
WITH c AS (SELECT source, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k FROM scored_docs GROUP BY 1)
SELECT source, round((k / n + 1.959964 * 1.959964 / (2 * n) - 1.959964 * sqrt(k / n * (1 - k / n) / n + 1.959964 * 1.959964 / (4 * n * n))) / (1 + 1.959964 * 1.959964 / n), 6) AS low,
 round((k / n + 1.959964 * 1.959964 / (2 * n) + 1.959964 * sqrt(k / n * (1 - k / n) / n + 1.959964 * 1.959964 / (4 * n * n))) / (1 + 1.959964 * 1.959964 / n), 6) AS high FROM c""")
def a22(t):
    c = t.scored_docs.groupBy("source").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("k"))
    low, high = st.wilson(F.col("k"), F.col("n"))
    return c.select("source", r6(low).alias("low"), r6(high).alias("high"))


@query("a23_sign_flip", sql=f"""
WITH c AS (SELECT l_returnflag, l_linenumber, l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS unit, avg(l_discount - l_tax) AS d FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT n, avg(CASE WHEN {_draw("unit", "n", 4)} % 2 = 0 THEN d ELSE -d END) AS m FROM c, (SELECT unnest(range(0, 200)) AS n) GROUP BY 1), o AS (SELECT avg(d) AS m FROM c)
SELECT round((SELECT m FROM o), 6) AS observed, count(*) FILTER (abs(f.m) >= abs(o.m) - 1e-12) AS as_large, round((1 + count(*) FILTER (abs(f.m) >= abs(o.m) - 1e-12)) / CAST(201 AS DOUBLE), 6) AS p FROM f, o""")
def a23(t):
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    c = t.lineitem.groupBy((F.col("l_linenumber") * 3 + code).alias("unit")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("d"))
    flips = c.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("s", F.when(rs.draw(F.col("unit").cast("long"), F.col("n").cast("long"), 4) % 2 == 0, F.col("d")).otherwise(-F.col("d")))
    f = flips.groupBy("n").agg(F.avg("s").alias("m"))
    larger = F.count_if(F.abs("m") >= F.abs("o") - 1e-12)
    return f.join(F.broadcast(c.agg(F.avg("d").alias("o")))).agg(r6(F.first("o")).alias("observed"), larger.alias("as_large"), r6((1 + larger) / 201.0).alias("p"))  # one observed mean


@query("a24_shift_null", views="px", sql=f"""
WITH m AS (SELECT * FROM px WHERE map_id = 0), s AS (SELECT unnest(range(1, 8)) * 8 AS dy, unnest(range(1, 8)) * 5 AS dx),
j AS (SELECT s.dy, l.ink, v.v AS level FROM m l, s JOIN m v ON v.y = l.y - l.y % 64 + (l.y + s.dy) % 64 AND v.x = (l.x + s.dx) % 64 WHERE l.sup = 1 AND v.v <> 0), h AS (SELECT dy, level, sum(ink) AS a, sum(1 - ink) AS b FROM j GROUP BY 1, 2)
{AUC.format(by="dy", hist="h")}""")
def a24(t):
    m = t.px.where("map_id = 0")
    shifts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct((i * 8).alias("dy"), (i * 5).alias("dx")))).alias("s")
    labels = m.where("sup = 1").select("y", "x", "ink", shifts).select("ink", F.col("s.dy").alias("dy"), (F.col("y") - F.col("y") % 64 + (F.col("y") + F.col("s.dy")) % 64).alias("y"), ((F.col("x") + F.col("s.dx")) % 64).alias("x"))
    return st.auc(labels.hint("merge").join(m.where("v <> 0").select("y", "x", "v"), ["y", "x"]), "v", "ink", ["dy"])  # seven rows for each pixel


@query("a24_offset_scan", views="px", sql=f"""
WITH m AS (SELECT * FROM px WHERE map_id = 0), s AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx)),
j AS (SELECT s.dy, s.dx, l.ink, v.v AS level FROM m l, s JOIN m v ON v.y = l.y + s.dy AND v.x = l.x + s.dx WHERE l.sup = 1 AND v.v <> 0), h AS (SELECT dy, dx, level, sum(ink) AS a, sum(1 - ink) AS b FROM j GROUP BY 1, 2, 3)
{AUC.format(by="dy, dx", hist="h")}""")
def a24b(t):
    m, shift = t.px.where("map_id = 0"), lambda: F.explode(F.sequence(F.lit(-2), F.lit(2)))
    labels = m.where("sup = 1").select("y", "x", "ink").withColumn("dy", shift()).withColumn("dx", shift())
    moved = labels.select("ink", "dy", "dx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    # 25 rows for each pixel, of which the planner sees one: never broadcast
    return st.auc(moved.hint("merge").join(m.where("v <> 0").select("y", "x", "v"), ["y", "x"]), "v", "ink", ["dy", "dx"])


@query("a26_pool_rates", sql="""
WITH p AS (SELECT l_suppkey, count(*) AS pairs, count(*) FILTER (l_returnflag = 'R') AS switches FROM lineitem GROUP BY 1)
SELECT sum(pairs)::BIGINT AS pairs, sum(switches)::BIGINT AS switches, round(1000 * sum(switches) / sum(pairs)::DOUBLE, 6) AS per_1000 FROM p""")
def a26(t):
    p = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("pairs"), F.count_if(F.col("l_returnflag") == "R").alias("switches"))
    return p.agg(F.sum("pairs").alias("pairs"), F.sum("switches").alias("switches"), r6(1000 * F.sum("switches") / F.sum("pairs")).alias("per_1000"))


@query("a31_row_periodicity", views="px", sql="""
WITH p AS (SELECT map_id, y, avg(v) AS m FROM px GROUP BY 1, 2), c AS (SELECT *, m - avg(m) OVER (PARTITION BY map_id) AS d FROM p),
s AS (SELECT a.map_id, l AS lag, sum(a.d * b.d) / sum(a.d * a.d) AS r FROM c a, (SELECT unnest(range(4, 17)) AS l) JOIN c b ON b.map_id = a.map_id AND b.y = a.y + l GROUP BY 1, 2)
SELECT map_id, round(max(r), 6) AS peak, round(max(r) - avg(r), 6) AS above_mean FROM s GROUP BY 1""")
def a31(t):
    rows = t.px.groupBy("map_id", "y").agg(F.avg("v").alias("m"))
    means = rows.groupBy("map_id").agg(F.avg("m").alias("mean"))
    c = rows.join(means, "map_id").select("map_id", "y", (F.col("m") - F.col("mean")).alias("d"))
    a = c.withColumn("lag", F.explode(F.sequence(F.lit(4), F.lit(16)))).select("map_id", "lag", (F.col("y") + F.col("lag")).alias("y"), "d")
    r = a.join(c.withColumnRenamed("d", "e"), ["map_id", "y"]).groupBy("map_id", "lag").agg((F.sum(F.col("d") * F.col("e")) / F.sum(F.col("d") * F.col("d"))).alias("r"))
    return r.groupBy("map_id").agg(r6(F.max("r")).alias("peak"), r6(F.max("r") - F.avg("r")).alias("above_mean"))


@query("a32_cost_rollup", views="bill", sql="""
SELECT flavor, date_trunc('year', started)::TIMESTAMP AS year, count(*) AS jobs, round(sum(greatest(cost, 1000)) / 1000, 4) AS typical, round(sum(greatest(cost * CAST(0.5 AS DOUBLE), 1000)) / 1000, 4) AS low, round(sum(greatest(cost * 2, 1000)) / 1000, 4) AS high FROM bill WHERE state = 'finished' GROUP BY 1, 2""")
def a32(t):
    cost = lambda k: F.round(F.sum(F.greatest(F.col("cost") * k, F.lit(1000.0))) / 1000, 4)
    return t.bill.where("state = 'finished'").groupBy("flavor", F.date_trunc("year", "started").alias("year")).agg(F.count("*").alias("jobs"), cost(1.0).alias("typical"), cost(0.5).alias("low"), cost(2.0).alias("high"))


@query("a33_caller_report", sql="""
SELECT user_id AS who, event_type AS method, count(*) AS calls, count(*) FILTER (json_extract(props, '$.k')::INT >= 90) AS limited, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS waited FROM events GROUP BY 1, 2""")
def a33(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.groupBy(F.col("user_id").alias("who"), F.col("event_type").alias("method")).agg(F.count("*").alias("calls"), F.count_if(k >= 90).alias("limited"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum("value"), 4).alias("waited"))


@query("a34_multiset_digest", sql="""
WITH h AS (SELECT sha256(l_orderkey || '|' || l_partkey || '|' || l_linenumber) AS h FROM lineitem)
SELECT count(*) AS rows, """ + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR AS limb{i}" for i in range(4)) + " FROM h")
def a34(t):
    return st.multiset_digest(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"))


@query("a35_classify_gain", sql="""
WITH s AS (SELECT l_shipdate, l_suppkey, avg(abs(l_tax - 0.04) - abs(l_discount - 0.05)) AS g FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, avg(g) AS g, stddev_samp(g) / sqrt(count(*)) AS se FROM s GROUP BY 1)
SELECT l_suppkey, round(g, 6) AS gain, CASE WHEN round(g - 2 * se, 9) > 0.0005 THEN 'gain' WHEN round(g + 2 * se, 9) < -0.0005 THEN 'harm' ELSE 'unresolved' END AS call FROM m""")
def a35(t):
    sites = t.lineitem.groupBy("l_shipdate", "l_suppkey").agg(F.avg(F.abs(F.col("l_tax") - 0.04) - F.abs(F.col("l_discount") - 0.05)).alias("g"))
    m = sites.groupBy("l_suppkey").agg(F.avg("g").alias("g"), (F.stddev_samp("g") / F.sqrt(F.count("*"))).alias("se"))
    return m.select("l_suppkey", r6("g").alias("gain"), F.when(F.round(F.col("g") - 2 * F.col("se"), 9) > 0.0005, "gain").when(F.round(F.col("g") + 2 * F.col("se"), 9) < -0.0005, "harm").otherwise("unresolved").alias("call"))


@query("a36_paired", views="px", sql=f"""WITH {_PAIR} SELECT count(*) AS n, round(avg(CASE WHEN p > q THEN 1 ELSE 0 END), 6) AS win_share, median(p - q) AS median_diff, avg(CASE WHEN p > q THEN 1 ELSE 0 END) > 0.5 AND median(p - q) > 0 AS passed FROM p""")
def a36(t):
    win, mid = F.avg((F.col("p") > F.col("q")).cast("double")), F.percentile(F.col("p") - F.col("q"), F.lit(0.5))
    return _pair(t).agg(F.count("*").alias("n"), r6(win).alias("win_share"), mid.alias("median_diff"), ((win > 0.5) & (mid > 0)).alias("passed"))


@query("a37_random_subsets", views="px", sql=f"""
WITH r AS (SELECT d, ink, row_number() OVER (PARTITION BY d ORDER BY {_draw("y * 64 + x", "d", 6)}, y * 64 + x) AS rk FROM px, (SELECT unnest(range(0, 20)) AS d) WHERE map_id = 0), s AS (SELECT d, avg(ink) AS share FROM r WHERE rk <= 500 GROUP BY 1)
SELECT count(*) AS n, round(avg(share), 6) AS mean, round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high FROM s""")
def a37(t):
    px = written(t.px.where("map_id = 0").select((F.col("y") * 64 + F.col("x")).alias("cell"), "ink"), "px").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(19))))
    shares = st.first_by_hash(px, "cell", ["d"], 6, 500, F.col("d")).groupBy("d").agg(F.avg("ink").alias("share"))
    return st.interval(shares, "share")


@query("a38_region_stats", views="px", sql="""
WITH b AS (SELECT * FROM px WHERE y BETWEEN 8 AND 55 AND x BETWEEN 8 AND 55), e AS (SELECT y, x, avg(v) AS ens FROM b GROUP BY 1, 2)
SELECT map_id, round(avg(v), 6) AS mean, quantile_cont(v, 0.5)::DOUBLE AS p50, round(quantile_cont(v, 0.99), 6) AS p99, round(corr(v, ens), 6) AS with_ensemble, max(v) > min(v) AS alive FROM b JOIN e USING (y, x) GROUP BY 1""")
def a38(t):
    box = t.px.where(F.col("y").between(8, 55) & F.col("x").between(8, 55)).select("map_id", "y", "x", "v")
    ens = box.groupBy("y", "x").agg(F.avg("v").alias("ens"))
    return box.join(ens, ["y", "x"]).groupBy("map_id").agg(r6(F.avg("v")).alias("mean"), F.percentile("v", F.lit(0.5)).alias("p50"), r6(F.percentile("v", F.lit(0.99))).alias("p99"), r6(F.corr("v", "ens")).alias("with_ensemble"), (F.max("v") > F.min("v")).alias("alive"))


@query("a39_paired_rates", sql=f"""
WITH u AS (SELECT l_suppkey AS unit, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS e1, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS e2, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT count(*) AS k FROM u), i AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS slot FROM u),
w AS (SELECT d, {_draw("slot", "d", 7)} % k AS slot, count(*) AS w FROM i, k, (SELECT unnest(range(0, 100)) AS d) GROUP BY 1, 2), r AS (SELECT d, sum((e1 - e2) * w)::DOUBLE / sum(n * w) AS diff FROM w JOIN i USING (slot) GROUP BY 1)
SELECT count(*) AS n, round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS low, round(quantile_cont(diff, 0.975), 6) AS high FROM r""")
def a39(t):
    err = lambda f: F.count_if(F.col("l_returnflag") == f)
    sums = t.lineitem.groupBy("l_suppkey").agg((err("R") - err("A")).alias("e"), F.count("*").alias("n"))
    units, k = rs.dense_units(sums, "l_suppkey")
    w = rs.resample_weights(units, k, 100, seed=7)
    diffs = w.join(units, "unit").join(sums, "l_suppkey").groupBy("draw").agg((F.sum(F.col("e") * F.col("weight")) / F.sum(F.col("n") * F.col("weight"))).alias("diff"))
    return st.interval(diffs, "diff")


@query("a40_phase_profile", views="px", sql=f"""WITH {_PAIR}, u AS (SELECT y % 8 AS phase, p, q FROM p UNION ALL SELECT x % 8, p, q FROM p)
SELECT phase, round(avg(abs(p - q)), 6) AS mean_diff, round(sqrt(avg((p - q) * (p - q))), 6) AS rms, round(corr(p, q), 6) AS pearson FROM u GROUP BY 1""")
def a40(t):
    both = _pair(t).select(F.explode(F.array(F.col("y") % 8, F.col("x") % 8)).alias("phase"), "p", "q")
    d = F.col("p") - F.col("q")
    return both.groupBy("phase").agg(r6(F.avg(F.abs(d))).alias("mean_diff"), r6(F.sqrt(F.avg(d * d))).alias("rms"), r6(F.corr("p", "q")).alias("pearson"))


@query("a41_control_gate", views="px", sql=f"""WITH {_PAIR}, a AS (SELECT quantile_cont(p, 0.5) AS base FROM p), z AS (SELECT * FROM p, a WHERE p >= base), b AS (SELECT quantile_cont(q, 0.9) AS cut FROM z)
SELECT count(*) AS zone, round(avg(CASE WHEN p > cut THEN 1 ELSE 0 END), 6) AS share, round(avg(CASE WHEN p > cut THEN 1 ELSE 0 END) - CAST(0.1 AS DOUBLE), 6) AS excess,
 CASE WHEN count(*) < 100 THEN 'too_small' WHEN max(p) = min(p) THEN 'unreadable' WHEN avg(CASE WHEN p > cut THEN 1 ELSE 0 END) >= 0.2 THEN 'ink' WHEN avg(CASE WHEN p > cut THEN 1 ELSE 0 END) > 0.1 THEN 'weak' ELSE 'none' END AS status FROM z, b""")
def a41(t):
    pair = _pair(t)
    zone = pair.join(F.broadcast(pair.agg(F.percentile("p", F.lit(0.5)).alias("base")))).where("p >= base")  # one row
    zone = zone.join(F.broadcast(zone.agg(F.percentile("q", F.lit(0.9)).alias("cut"))))  # one row
    share = F.avg((F.col("p") > F.col("cut")).cast("double"))
    status = F.when(F.count("*") < 100, "too_small").when(F.max("p") == F.min("p"), "unreadable").when(share >= 0.2, "ink").when(share > 0.1, "weak").otherwise("none")
    return zone.agg(F.count("*").alias("zone"), r6(share).alias("share"), r6(share - 0.1).alias("excess"), status.alias("status"))


@query("a42_pool", views="px", sql="SELECT map_id, y // 4 AS y, x // 4 AS x, round_even(avg(v), 0) AS v, max(ink) AS ink, count(*) AS n FROM px GROUP BY 1, 2, 3")
def a42(t):
    cell = lambda c: F.floor(F.col(c) / 4).cast("int").alias(c)
    return t.px.groupBy("map_id", cell("y"), cell("x")).agg(F.bround(F.avg("v")).alias("v"), F.max("ink").alias("ink"), F.count("*").alias("n"))


@query("a43_arm_scores", views="px", sql=f"""
WITH {_SCORED}, h AS (SELECT map_id, v AS level, sum(ink) AS a, sum(1 - ink) AS b FROM sc GROUP BY 1, 2), r AS ({AUC.format(by="map_id", hist="h")})
SELECT r.map_id AS arm, r.n_pos, r.n_neg, r.auc, round(r.auc - c.auc, 6) AS gap FROM r, r c WHERE c.map_id = 0""")
def a43(t):
    r = st.auc(st.select_scored(t.px, 64, 2), "v", "ink", ["map_id"])
    ref = r.where("map_id = 0").select(F.col("auc").alias("reference"))
    return r.join(F.broadcast(ref)).select(F.col("map_id").alias("arm"), "n_pos", "n_neg", "auc", r6(F.col("auc") - F.col("reference")).alias("gap"))  # one row


@query("w1_mid_ranks", views="px", sql="""
SELECT map_id, y, x, round((rank() OVER (PARTITION BY map_id ORDER BY v) + (count(*) OVER (PARTITION BY map_id, v) - 1) / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY map_id), 6) AS rank FROM px WHERE v <> 0""")
def w1(t):
    px = t.px.where("v <> 0").select("map_id", "y", "x", "v")
    n = px.groupBy("map_id").agg(F.count("*").alias("n"))
    return st.mid_rank(px, "v", ["map_id"]).join(n, "map_id").select("map_id", "y", "x", r6((F.col("rank") - 0.5) / F.col("n")).alias("rank"))


@query("w4_average_rank", sql="SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / CAST(2 AS DOUBLE) AS rank FROM supplier")
def w4(t):
    return st.mid_rank(t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), "s_acctbal", ["s_nationkey"]).drop("s_acctbal")


@query("w2_signal_rank", sql="""
SELECT c_custkey, round(CASE WHEN c_acctbal IS NULL THEN NULL ELSE 1 - (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY c_mktsegment) END, 6) AS rank FROM customer""")
def w2(t):
    c = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    n = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return st.mid_rank(c, "c_acctbal", ["c_mktsegment"]).join(n, "c_mktsegment").select("c_custkey", r6(1 - (F.col("rank") - 0.5) / F.col("n")).alias("rank"))


@query("s13_curves_long", views="px", sql=f"""
WITH {_SCORED}, h AS (SELECT map_id, v AS level, sum(ink)::DOUBLE AS a, sum(1 - ink)::DOUBLE AS b FROM sc GROUP BY 1, 2),
c AS (SELECT map_id, level, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY map_id) AS p, sum(b) OVER (PARTITION BY map_id) AS n FROM h WINDOW w AS (PARTITION BY map_id ORDER BY level DESC))
SELECT map_id, 'roc' AS curve, level, round(fp / n, 6) AS x, round(tp / p, 6) AS y FROM c UNION ALL SELECT map_id, 'pr', level, round(tp / p, 6), round(tp / (tp + fp), 6) FROM c""")
def s13(t):
    at = st.curve(st.histogram(st.select_scored(t.px, 64, 2), "v", "ink", ["map_id"]), ["map_id"])
    tpr, fpr, prec = F.col("tp") / F.col("P"), F.col("fp") / F.col("N"), F.col("tp") / (F.col("tp") + F.col("fp"))
    point = lambda name, x, y: F.struct(F.lit(name).alias("curve"), r6(x).alias("x"), r6(y).alias("y"))
    return at.select("map_id", "level", F.explode(F.array(point("roc", fpr, tpr), point("pr", tpr, prec))).alias("c")).select("map_id", "c.curve", "level", "c.x", "c.y")
