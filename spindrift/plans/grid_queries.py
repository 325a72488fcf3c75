"""Queries of the spatial joins, grids, meshes and ordered windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import grids as gr
from ..operators import spatial as sp
from ..operators.stats import r6
from .registry import query


@query("p4_box_touches", views="boxes", sql="SELECT family, count(*) AS n FROM boxes WHERE bmax_x >= 200 AND bmin_x < 500 AND bmax_y >= 100 AND bmin_y < 700 GROUP BY 1")
def p4(t):
    return t.boxes.where(sp.box_touches({"x": (200, 500), "y": (100, 700)})).groupBy("family").agg(F.count("*").alias("n"))


@query("s1_box_scan", views="boxes", sql="SELECT id, family, length_mm FROM boxes WHERE bmax_x >= 100 AND bmin_x < 300 AND bmax_y >= 100 AND bmin_y < 400 AND bmax_z >= 50 AND bmin_z < 600 AND family = 'R' AND length_mm >= 10")
def s1(t):
    return sp.box_scan(t.boxes, {"x": (100, 300), "y": (100, 400), "z": (50, 600)}, "R", 10).select("id", "family", "length_mm")


@query("s2_morton_cells", views="boxes", sql="""
WITH c AS (SELECT floor((bmin_x + bmax_x) / 2 / 64)::INT AS cx, floor((bmin_y + bmax_y) / 2 / 64)::INT AS cy FROM boxes)
SELECT (SELECT sum(((cx >> i) & 1) << (2 * i)) + sum(((cy >> i) & 1) << (2 * i + 1)) FROM range(0, 10) r(i))::BIGINT AS morton, count(*) AS n FROM c GROUP BY cx, cy""")
def s2(t):
    cells = [F.floor((F.col(f"bmin_{a}") + F.col(f"bmax_{a}")) / 2 / 64).cast("int") for a in "xy"]
    return t.boxes.groupBy(sp.morton(cells).alias("morton")).agg(F.count("*").alias("n"))


@query("s3_verify_layout", views="boxes", sql="""
WITH i AS (SELECT id, count(*) AS n FROM boxes GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS ids, count(*) FILTER (n > 1) AS twice, 0::BIGINT AS lost, 0::BIGINT AS "foreign" FROM i""")
def s3(t):
    return sp.verify_layout(t.boxes, t.boxes)


@query("j1_labels_on_map", views="px", sql="""
SELECT m.map_id, count(*) AS n, sum(l.ink)::BIGINT AS ink FROM px m JOIN px l ON l.map_id = 2 AND l.y = floor((m.y + 0.5) * 0.5) AND l.x = floor((m.x + 0.5) * 0.5) WHERE m.map_id < 2 AND l.sup = 1 GROUP BY 1""")
def j1(t):
    labels = t.px.where("map_id = 2 and sup = 1").select(F.col("y").alias("ly"), F.col("x").alias("lx"), "ink")
    at = lambda c: F.floor((F.col(c) + 0.5) * 0.5)
    m = t.px.where("map_id < 2").select("map_id", at("y").alias("ly"), at("x").alias("lx"))
    return m.join(labels, ["ly", "lx"]).groupBy("map_id").agg(F.count("*").alias("n"), F.sum("ink").alias("ink"))


@query("j2_align_maps", views="px", sql="SELECT y, x, max(v) FILTER (map_id = 0) AS m0, max(v) FILTER (map_id = 1) AS m1, max(v) FILTER (map_id = 2) AS m2 FROM px GROUP BY 1, 2 HAVING count(*) = 3")
def j2(t):
    wide = t.px.groupBy("y", "x").pivot("map_id", [0, 1, 2]).agg(F.first("v"))
    return wide.select("y", "x", *[F.col(str(i)).alias(f"m{i}") for i in range(3)]).dropna()


_AB = "a AS (SELECT m, r, c, x, y, z FROM spiral WHERE m % 2 = 0), b AS (SELECT m, r, c, x, y, z FROM spiral WHERE m % 2 = 1)"


@query("j3_nearest_join", views="spiral", sql=f"""
WITH {_AB}, p AS (SELECT a.m, a.r, a.c, b.m AS bm, b.r AS br, b.c AS bc, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 6) AS d2 FROM a JOIN b ON b.z BETWEEN a.z - 60 AND a.z + 60 AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 3600),
n AS (SELECT *, row_number() OVER (PARTITION BY m, r, c ORDER BY d2, bm, br, bc) AS rn FROM p) SELECT m, r, c, bm, br, bc, round(sqrt(d2), 6) AS distance FROM n WHERE rn = 1""")
def j3(t):
    a, b = t.spiral.where("m % 2 = 0"), t.spiral.where("m % 2 = 1").select(F.col("m").alias("bm"), F.col("r").alias("br"), F.col("c").alias("bc"), "x", "y", "z")
    return sp.nearest_join(a, b, ["x", "y", "z"], ["m", "r", "c"], 60.0, ["bm", "br", "bc"])


@query("j4_near", views="spiral", sql=f"""
WITH {_AB}, k AS (SELECT DISTINCT floor(x / 45) AS i, floor(y / 45) AS j, floor(z / 45) AS l FROM b) SELECT m, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM k WHERE abs(i - floor(a.x / 45)) <= 1 AND abs(j - floor(a.y / 45)) <= 1 AND abs(l - floor(a.z / 45)) <= 1)) AS near FROM a GROUP BY 1""")
def j4(t):
    a, b = t.spiral.where("m % 2 = 0"), t.spiral.where("m % 2 = 1")
    axes = ["x", "y", "z"]
    semi, anti = sp.near(a, b, axes, 45.0).withColumn("near", F.lit(1)), sp.near(a, b, axes, 45.0, "left_anti").withColumn("near", F.lit(0))
    return semi.unionByName(anti).groupBy("m").agg(F.count("*").alias("n"), F.sum("near").alias("near"))


_NORMAL = """p AS (SELECT a.m, a.r, a.c, b.m AS bm, ((b.x - a.x) * (a.x - 1000) + (b.y - a.y) * (a.y - 1000)) / sqrt((a.x - 1000) ** 2 + (a.y - 1000) ** 2) AS off, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2
 FROM spiral a JOIN spiral b ON a.m <> b.m AND b.z BETWEEN a.z - 90 AND a.z + 90 AND b.x BETWEEN a.x - 90 AND a.x + 90 AND b.y BETWEEN a.y - 90 AND a.y + 90 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 8100),
q AS (SELECT * FROM p WHERE d2 - off * off <= 2450)"""


def _normal_pairs(t):
    """Pairs of vertices of different meshes within reach: signed offset along the first's radial normal, within the footprint."""
    pairs = sp.within(t.spiral, t.spiral, ["x", "y", "z"], 90.0).where("m <> b_m")
    norm = F.sqrt((F.col("x") - 1000) ** 2 + (F.col("y") - 1000) ** 2)
    off = ((F.col("b_x") - F.col("x")) * (F.col("x") - 1000) + (F.col("b_y") - F.col("y")) * (F.col("y") - 1000)) / norm
    return pairs.withColumn("off", off).where(F.col("d2") - F.col("off") * F.col("off") <= 2450)


@query("j5_normal_offset", views="spiral", sql=f"WITH {_NORMAL} SELECT m, r, c, round(min(abs(off)), 6) AS offset_abs, count(*) AS candidates FROM q GROUP BY 1, 2, 3")
def j5(t):
    return _normal_pairs(t).groupBy("m", "r", "c").agg(r6(F.min(F.abs("off"))).alias("offset_abs"), F.count("*").alias("candidates"))


@query("j6_two_sided", views="spiral", sql=f"WITH {_NORMAL} SELECT m, r, c, round(min(off) FILTER (off > 0), 6) AS outward, round(min(-off) FILTER (off < 0), 6) AS inward FROM q GROUP BY 1, 2, 3")
def j6(t):
    return _normal_pairs(t).groupBy("m", "r", "c").agg(r6(F.min(F.when(F.col("off") > 0, F.col("off")))).alias("outward"), r6(F.min(F.when(F.col("off") < 0, -F.col("off")))).alias("inward"))


@query("j19_exposure_matrix", views="spiral", sql=f"""WITH {_NORMAL}, n AS (SELECT m, bm, r, c, min(abs(off)) AS o FROM q GROUP BY 1, 2, 3, 4), s AS (SELECT m, count(*) AS total FROM spiral GROUP BY 1)
SELECT n.m AS eval_mesh, n.bm AS train_mesh, count(*) AS matched, round(count(*) FILTER (o <= 42) / max(total)::DOUBLE, 6) AS share_42, round(median(o), 6) AS median, CASE WHEN count(*) FILTER (o <= 42) / max(total)::DOUBLE > 0.5 THEN 'exposed' ELSE 'clear' END AS call FROM n JOIN s ON s.m = n.m GROUP BY 1, 2""")
def j19(t):
    best = _normal_pairs(t).groupBy("m", F.col("b_m").alias("train_mesh"), "r", "c").agg(F.min(F.abs("off")).alias("o"))
    totals = t.spiral.groupBy("m").agg(F.count("*").alias("total"))
    share = F.count_if(F.col("o") <= 42) / F.max("total")
    out = best.join(totals, "m").groupBy(F.col("m").alias("eval_mesh"), "train_mesh").agg(F.count("*").alias("matched"), r6(share).alias("share_42"), r6(F.percentile("o", F.lit(0.5))).alias("median"), F.when(share > 0.5, "exposed").otherwise("clear").alias("call"))
    return out


@query("j21_pair_stats", views="spiral", sql=f"""WITH {_NORMAL}, n AS (SELECT m, bm, r, c, arg_min(off, abs(off)) AS o FROM q GROUP BY 1, 2, 3, 4)
SELECT m AS a, bm AS b, count(*) AS matched, round(avg(CASE WHEN abs(o) <= 41 THEN 1 ELSE 0 END), 6) AS within_41, round(median(o), 6) AS median_offset, sign(median(o))::INT AS side FROM n GROUP BY 1, 2""")
def j21(t):
    best = _normal_pairs(t).groupBy("m", "b_m", "r", "c").agg(F.min_by("off", F.abs("off")).alias("o"))
    mid = F.percentile("o", F.lit(0.5))
    return best.groupBy(F.col("m").alias("a"), F.col("b_m").alias("b")).agg(F.count("*").alias("matched"), r6(F.avg((F.abs("o") <= 41).cast("double"))).alias("within_41"), r6(mid).alias("median_offset"), F.signum(mid).cast("int").alias("side"))


@query("j7_sector_within", sql="""
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 360 AS arc, o_custkey % 500 AS z, o_orderstatus AS s FROM orders)
SELECT k FROM p q WHERE s = 'P' AND EXISTS (SELECT 1 FROM p t WHERE t.s = 'F' AND abs(t.z - q.z) <= 2 AND least(abs(t.arc - q.arc), 360 - abs(t.arc - q.arc)) <= 3)""")
def j7(t):
    p = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 360).alias("arc"), (F.col("o_custkey") % 500).alias("z"), "o_orderstatus")
    marks = p.where("o_orderstatus = 'F'").select(F.col("arc").alias("ta"), F.col("z").alias("tz")).distinct()
    # every whole degree and height that a mark reaches; the circle closes by the remainder
    reach = marks.withColumn("arc", F.explode(F.sequence(F.col("ta") - 3, F.col("ta") + 3))).withColumn("z", F.explode(F.sequence(F.col("tz") - 2, F.col("tz") + 2)))
    reach = reach.select(F.pmod("arc", F.lit(360)).alias("arc"), "z").distinct()
    return p.where("o_orderstatus = 'P'").join(reach, ["arc", "z"], "left_semi").select("k")


@query("j8_box_pairs", views="boxes", sql="""
WITH s AS (SELECT DISTINCT ON (id) * FROM boxes WHERE length_mm >= 45 AND family = 'R' ORDER BY id, bmin_x, bmin_y, bmin_z)
SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.id < b.id AND a.bmin_x <= b.bmax_x AND b.bmin_x <= a.bmax_x AND a.bmin_y <= b.bmax_y AND b.bmin_y <= a.bmax_y AND a.bmin_z <= b.bmax_z AND b.bmin_z <= a.bmax_z""")
def j8(t):
    long_ = t.boxes.where("length_mm >= 45 and family = 'R'")
    rest = [c for c in long_.columns if c != "id"]
    once = long_.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("bmin_x", "bmin_y", "bmin_z")).alias("r")).select("id", "r.*")
    return sp.box_pairs(once, ["x", "y", "z"], 50.0)


@query("j9_asof_interp", sql="""
WITH line AS (SELECT s_suppkey * 9.5::DOUBLE AS z, s_acctbal AS v FROM supplier), iv AS (SELECT z, v, lead(z) OVER (ORDER BY z) AS z2, lead(v) OVER (ORDER BY z) AS v2 FROM line), p AS (SELECT o_orderkey, (o_orderkey % 1000)::DOUBLE AS z FROM orders)
SELECT o_orderkey, round(CASE WHEN p.z < (SELECT min(z) FROM line) THEN (SELECT arg_min(v, z) FROM line) WHEN p.z >= (SELECT max(z) FROM line) THEN (SELECT arg_max(v, z) FROM line) ELSE iv.v + (iv.v2 - iv.v) * (p.z - iv.z) / (iv.z2 - iv.z) END, 6) AS v FROM p LEFT JOIN iv ON p.z >= iv.z AND p.z < iv.z2""")
def j9(t):
    line = t.supplier.select((F.col("s_suppkey") * 9.5).alias("z"), F.col("s_acctbal").alias("v"))
    points = t.orders.select("o_orderkey", (F.col("o_orderkey") % 1000).cast("double").alias("z"))
    return sp.asof_interp(points, line, "z", "v", 20.0).select("o_orderkey", r6("v").alias("v"))


@query("j15_grid_pairs", views="px", sql="""
SELECT map_id, (SELECT count(*) FROM px a JOIN px b ON a.map_id = b.map_id AND a.y = b.y AND b.x = a.x + 1 WHERE a.map_id = p.map_id) AS across, (SELECT count(*) FROM px a JOIN px b ON a.map_id = b.map_id AND a.x = b.x AND b.y = a.y + 1 WHERE a.map_id = p.map_id) AS down FROM px p GROUP BY 1""")
def j15(t):
    return gr.neighbours(t.px, ["map_id"], "y", "x", "v").groupBy("map_id").agg(F.count("right").alias("across"), F.count("below").alias("down"))


@query("j16_displaced", views="px", sql="""
SELECT d, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM px a, (SELECT unnest(range(1, 9)) AS d) JOIN px b ON b.map_id = 1 AND b.y = a.y + d * 3 AND b.x = a.x + d * 2 WHERE a.map_id = 0 GROUP BY 1""")
def j16(t):
    a = t.px.where("map_id = 0").withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("d", (F.col("y") + F.col("d") * 3).alias("y"), (F.col("x") + F.col("d") * 2).alias("x"), F.col("v").alias("p"))
    return a.join(t.px.where("map_id = 1").select("y", "x", "v"), ["y", "x"]).groupBy("d").agg(F.count("*").alias("n"), r6(F.corr("p", "v")).alias("r"))


@query("j18_touched_chunks", views="spiral", sql="""
WITH t AS (SELECT DISTINCT m, cx, cy FROM (SELECT m, x, y, unnest(range(floor((x - 20) / 128)::BIGINT, floor((x + 20) / 128)::BIGINT + 1)) AS cx FROM spiral), LATERAL (SELECT unnest(range(floor((y - 20) / 128)::BIGINT, floor((y + 20) / 128)::BIGINT + 1)) AS cy))
SELECT m, count(*) AS chunks, sum(abs(cx * 31 + cy * 17) % 97)::BIGINT AS bytes FROM t WHERE abs(cx + cy) % 5 <> 0 GROUP BY 1""")
def j18(t):
    c = sp.touched_chunks(t.spiral, 128.0, 20.0, ["x", "y"]).where(F.abs(F.col("cx") + F.col("cy")) % 5 != 0)
    return c.groupBy("m").agg(F.count("*").alias("chunks"), F.sum(F.abs(F.col("cx") * 31 + F.col("cy") * 17) % 97).alias("bytes"))


@query("w3_smooth", views="px", sql="SELECT a.map_id, a.y, a.x, round(avg(b.v), 6) AS smooth FROM px a JOIN px b ON a.map_id = b.map_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3")
def w3(t):
    px, parts = t.dealt_px()
    return gr.smooth3x3(px, ["map_id"], "v", parts).withColumn("smooth", r6("smooth"))


@query("w16_box_sum", views="px", sql="SELECT a.map_id, a.y, a.x, sum(b.ink)::BIGINT AS box FROM px a JOIN px b ON a.map_id = b.map_id AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 GROUP BY 1, 2, 3")
def w16(t):
    px, parts = t.dealt_px()
    return gr.box_sum(px, ["map_id"], "ink", 3, parts=parts)


@query("w17_high_pass", views="px", sql="""
WITH k AS (SELECT k, exp(-k * k / CAST(8 AS DOUBLE)) AS w FROM (SELECT unnest(range(-6, 7)) AS k)), m AS (SELECT * FROM px WHERE map_id = 0),
a AS (SELECT y, x + k AS x, sum(v * w) AS s, sum(w) AS n FROM m, k GROUP BY 1, 2), b AS (SELECT y + k AS y, x, sum(s * w) AS s, sum(n * w) AS n FROM a, k GROUP BY 1, 2)
SELECT m.y, m.x, round(m.v - b.s / b.n, 6) AS high FROM m JOIN b ON m.y = b.y AND m.x = b.x""")
def w17(t):
    out = gr.gaussian(t.px.where("map_id = 0").select("y", "x", "v"), [], "v", 2.0)
    return out.select("y", "x", r6(F.col("v") - F.col("blur")).alias("high"))


@query("w18_call_edge", views="px", sql="""
SELECT a.map_id, count(*) FILTER (EXISTS (SELECT 1 FROM px b WHERE b.map_id = a.map_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND (b.v >= 128) <> (a.v >= 128))) AS edges, count(*) AS n FROM px a GROUP BY 1""")
def w18(t):
    px = t.px.select("map_id", "y", "x", (F.col("v") >= 128).alias("call"))
    across, down = W.partitionBy("map_id", "y").orderBy("x"), W.partitionBy("map_id", "x").orderBy("y")
    differs = lambda w, axis, way, k: F.coalesce((way(axis).over(w) == F.col(axis) + k) & (way("call").over(w) != F.col("call")), F.lit(False))
    edge = differs(across, "x", F.lead, 1) | differs(across, "x", F.lag, -1) | differs(down, "y", F.lead, 1) | differs(down, "y", F.lag, -1)
    return px.withColumn("edge", edge).groupBy("map_id").agg(F.count_if("edge").alias("edges"), F.count("*").alias("n"))


@query("w6_split_chains", sql="""
WITH f AS (SELECT o_custkey AS chain, o_orderkey AS seq, o_totalprice > 400000 AS flag FROM orders), p AS (SELECT *, sum(flag::INT) OVER (PARTITION BY chain ORDER BY seq) AS piece FROM f)
SELECT chain, piece::BIGINT AS piece, count(*) AS n, min(seq) AS first_seq FROM p GROUP BY 1, 2""")
def w6(t):
    w = W.partitionBy("chain").orderBy("seq")
    f = t.orders.select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") > 400000).cast("int").alias("flag"))
    return f.withColumn("piece", F.sum("flag").over(w)).groupBy("chain", "piece").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("w7_runs", sql="""
WITH f AS (SELECT user_id, event_id, value > 5 AS f, sum(CASE WHEN value > 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) SELECT user_id, min(event_id) AS start, max(event_id) AS stop, count(*) AS n FROM f WHERE f GROUP BY user_id, g""")
def w7(t):
    return gr.islands(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 5)


_TH = "th AS (SELECT m, r, c, z, ((degrees(atan2(y - 1000, x - 1000)) % 360) + 360) % 360 AS theta, sqrt((x - 1000) ** 2 + (y - 1000) ** 2) AS radius FROM spiral)"


@query("w7_largest_arc", sql="""
WITH b AS (SELECT DISTINCT o_custkey AS g, o_orderkey % 36 AS b FROM orders), n AS (SELECT g, b, coalesce(lead(b) OVER (PARTITION BY g ORDER BY b), first(b) OVER (PARTITION BY g ORDER BY b) + 36) AS nx FROM b) SELECT g, max(nx - b - 1) AS largest_arc, count(*) AS bins FROM n GROUP BY 1""")
def w7b(t):
    return gr.largest_arc(t.orders.select(F.col("o_custkey").alias("g"), (F.col("o_orderkey") % 36).alias("b")), ["g"], "b", 36)


@query("e1_polar", views="spiral", sql=f"WITH {_TH} SELECT m, r, c, round(theta, 4) AS theta, round(radius, 6) AS radius FROM th WHERE c % 60 <> 0")
def e1(t):
    return gr.polar(t.spiral.where("c % 60 <> 0"), 1000.0, 1000.0).select("m", "r", "c", F.round("theta", 4).alias("theta"), r6("radius").alias("radius"))


@query("w9_unwrap", sql="""
WITH a AS (SELECT o_custkey AS g, o_orderkey AS k, (o_orderkey * 77 % 360)::DOUBLE AS a FROM orders), s AS (SELECT *, a - lag(a) OVER (PARTITION BY g ORDER BY k) AS d FROM a)
SELECT g, k, a + sum(CASE WHEN d > 180 THEN -360 WHEN d < -180 THEN 360 ELSE 0 END) OVER (PARTITION BY g ORDER BY k) AS unwrapped FROM s""")
def w9(t):
    a = t.orders.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 77 % 360).cast("double").alias("a"))
    return gr.unwrap(a, ["g"], "k", "a").select("g", "k", "unwrapped")


@query("a28_coverage_grid", views="spiral", sql=f"WITH {_TH} SELECT floor(z / 40)::INT AS zb, (floor((theta + 1.5) / 12)::INT) % 30 AS tb, count(DISTINCT m) AS meshes, round(avg(radius), 6) AS mean_radius FROM th GROUP BY 1, 2")
def a28(t):
    p = gr.polar(t.spiral, 1000.0, 1000.0)
    return p.groupBy(F.floor(F.col("z") / 40).cast("int").alias("zb"), (F.floor((F.col("theta") + 1.5) / 12).cast("int") % 30).alias("tb")).agg(F.countDistinct("m").alias("meshes"), r6(F.avg("radius")).alias("mean_radius"))


@query("w10_passes", sql="""
WITH s AS (SELECT l_suppkey AS cell, l_extendedprice AS r, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) >= 500 THEN 1 ELSE 0 END AS j FROM lineitem), p AS (SELECT cell, r, sum(j) OVER (PARTITION BY cell ORDER BY r) AS pass FROM s)
SELECT cell, pass::BIGINT AS pass, count(*) AS n, round(sum(r), 2) AS total_r FROM p GROUP BY 1, 2""")
def w10(t):
    w = W.partitionBy("cell").orderBy("r")
    s = t.lineitem.select(F.col("l_suppkey").alias("cell"), F.col("l_extendedprice").alias("r"))
    jumps = s.withColumn("j", F.when(F.col("r") - F.lag("r").over(w) >= 500, 1).otherwise(0)).withColumn("pass", F.sum("j").over(w))
    return jumps.groupBy("cell", "pass").agg(F.count("*").alias("n"), F.round(F.sum("r"), 2).alias("total_r"))


@query("w11_missing_wraps", views="spiral", sql=f"""
WITH {_TH}, p AS (SELECT r AS zr, c AS tc, m, radius AS rad FROM th), n AS (SELECT m, rad, lead(m) OVER w AS m2, lead(rad) OVER w AS rad2 FROM p WINDOW w AS (PARTITION BY zr, tc ORDER BY rad)), g AS (SELECT least(m, m2) AS a, greatest(m, m2) AS b, count(*) AS cells, median(rad2 - rad) AS step, count(*) FILTER (m < m2) AS first_inner FROM n WHERE m2 IS NOT NULL AND m2 <> m GROUP BY 1, 2)
SELECT a, b, cells, round(step, 6) AS step, CASE WHEN first_inner * 2 >= cells THEN a ELSE b END AS inner_mesh, greatest(0, round(step / 40) - 1)::INT AS wraps_missing FROM g""")
def w11(t):
    p = gr.polar(t.spiral, 1000.0, 1000.0)
    w = W.partitionBy("r", "c").orderBy("radius")
    n = p.select("m", "radius", F.lead("m").over(w).alias("m2"), F.lead("radius").over(w).alias("radius2")).where("m2 is not null and m2 <> m")
    g = n.groupBy(F.least("m", "m2").alias("a"), F.greatest("m", "m2").alias("b")).agg(F.count("*").alias("cells"), F.percentile(F.col("radius2") - F.col("radius"), F.lit(0.5)).alias("step"), F.count_if(F.col("m") < F.col("m2")).alias("first_inner"))
    return g.select("a", "b", "cells", r6("step").alias("step"), F.when(F.col("first_inner") * 2 >= F.col("cells"), F.col("a")).otherwise(F.col("b")).alias("inner_mesh"), F.greatest(F.lit(0), F.round(F.col("step") / 40) - 1).cast("int").alias("wraps_missing"))


@query("w15_switches", sql="""
WITH s AS (SELECT user_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sw FROM events) SELECT user_id, count(*) FILTER (sw) AS switches, count(*) AS n FROM s GROUP BY 1""")
def w15(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("sw", F.col("event_type") != F.lag("event_type").over(w)).groupBy("user_id").agg(F.count_if("sw").alias("switches"), F.count("*").alias("n"))


@query("w20_hist_match", views="px", sql="""
WITH h AS (SELECT map_id, v, count(*) AS n FROM px WHERE map_id < 2 GROUP BY 1, 2), c AS (SELECT map_id, v, sum(n) OVER (PARTITION BY map_id ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY map_id) AS cdf FROM h)
SELECT a.v AS level, (SELECT min(b.v) FROM c b WHERE b.map_id = 1 AND b.cdf >= a.cdf - 1e-12) AS matched FROM c a WHERE a.map_id = 0""")
def w20(t):
    h = t.px.where("map_id < 2").groupBy("map_id", "v").agg(F.count("*").alias("n"))
    w = W.partitionBy("map_id")  # at most 65,536 levels a map
    c = h.select("map_id", "v", (F.sum("n").over(w.orderBy("v")) / F.sum("n").over(w)).alias("cdf"))
    steps = c.where("map_id = 1").select("v", "cdf", F.coalesce(F.lag("cdf").over(W.orderBy("v")), F.lit(-1.0)).alias("prev"))
    on = (F.col("a.cdf") - 1e-12 <= F.col("b.cdf")) & (F.col("a.cdf") - 1e-12 > F.col("b.prev"))
    return c.where("map_id = 0").alias("a").join(F.broadcast(steps.alias("b")), on).select(F.col("a.v").alias("level"), F.col("b.v").alias("matched"))  # at most 65,536 levels


@query("w21_cumulative", sql="SELECT o_orderpriority, yr, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY yr)::BIGINT AS total FROM (SELECT o_orderpriority, year(o_orderdate)::INT AS yr, count(*) AS n FROM orders GROUP BY 1, 2)")
def w21(t):
    n = t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    return n.select("o_orderpriority", "yr", F.sum("n").over(W.partitionBy("o_orderpriority").orderBy("yr")).alias("total"))


@query("w23_missing_sides", sql="WITH d AS (SELECT DISTINCT o_custkey AS g, o_orderkey // 500 AS k FROM orders) SELECT g, k, coalesce(lead(k) OVER w <> k + 1, true) AS outer_missing, coalesce(lag(k) OVER w <> k - 1, true) AS inner_missing FROM d WINDOW w AS (PARTITION BY g ORDER BY k)")
def w23(t):
    d = t.orders.select(F.col("o_custkey").alias("g"), F.floor(F.col("o_orderkey") / 500).alias("k")).distinct()
    w = W.partitionBy("g").orderBy("k")
    return d.select("g", "k", F.coalesce(F.lead("k").over(w) != F.col("k") + 1, F.lit(True)).alias("outer_missing"), F.coalesce(F.lag("k").over(w) != F.col("k") - 1, F.lit(True)).alias("inner_missing"))


@query("a29_measure_mesh", views="spiral", sql="""
WITH q AS (SELECT p.m, p.x AS x0, p.y AS y0, p.z AS z0, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, d.x AS x3, d.y AS y3, d.z AS z3 FROM spiral p JOIN spiral a ON a.m = p.m AND a.r = p.r AND a.c = p.c + 1 JOIN spiral b ON b.m = p.m AND b.r = p.r + 1 AND b.c = p.c JOIN spiral d ON d.m = p.m AND d.r = p.r + 1 AND d.c = p.c + 1),
v AS (SELECT m, sqrt(((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0))**2 + ((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0))**2 + ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))**2) / 2 + sqrt(((y1-y3)*(z2-z3)-(z1-z3)*(y2-y3))**2 + ((z1-z3)*(x2-x3)-(x1-x3)*(z2-z3))**2 + ((x1-x3)*(y2-y3)-(y1-y3)*(x2-x3))**2) / 2 AS area,
 sqrt((x1-x0)**2 + (y1-y0)**2 + (z1-z0)**2) / sqrt((x2-x0)**2 + (y2-y0)**2 + (z2-z0)**2) AS ratio FROM q)
SELECT m, count(*) AS cells, round(sum(area), 4) AS area, round(median(ratio), 6) AS edge_ratio, round(quantile_cont(area, 0.95), 6) AS area_p95 FROM v GROUP BY 1""")
def a29(t):
    q = gr.quads(t.spiral)
    ratio = gr.length(gr.minus("p01", "p00")) / gr.length(gr.minus("p10", "p00"))
    v = q.select("m", gr.cell_area().alias("area"), ratio.alias("ratio"))
    return v.groupBy("m").agg(F.count("*").alias("cells"), F.round(F.sum("area"), 4).alias("area"), r6(F.percentile("ratio", F.lit(0.5))).alias("edge_ratio"), r6(F.percentile("area", F.lit(0.95))).alias("area_p95"))


@query("e3_densify", views="spiral", sql="""
WITH q AS (SELECT p.m, p.r, p.c, p.x AS x0, a.x AS x1, b.x AS x2, d.x AS x3 FROM spiral p JOIN spiral a ON a.m = p.m AND a.r = p.r AND a.c = p.c + 1 JOIN spiral b ON b.m = p.m AND b.r = p.r + 1 AND b.c = p.c JOIN spiral d ON d.m = p.m AND d.r = p.r + 1 AND d.c = p.c + 1)
SELECT m, (r * 2 + i)::INT AS r, (c * 2 + j)::INT AS c, round(x0 * (1 - i / 2.0::DOUBLE) * (1 - j / 2.0::DOUBLE) + x1 * (1 - i / 2.0::DOUBLE) * j / 2.0::DOUBLE + x2 * i / 2.0::DOUBLE * (1 - j / 2.0::DOUBLE) + x3 * i / 2.0::DOUBLE * j / 2.0::DOUBLE, 6) AS x FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""")
def e3(t):
    return gr.densify(t.spiral, 2).select("m", "r", "c", r6("x").alias("x"))


@query("e4_facing", views="spiral", sql="SELECT m, round(avg(CASE WHEN c2 = c + 1 AND (x - 1000) * (y2 - 1000) - (y - 1000) * (x2 - 1000) > 0 THEN 1 WHEN c2 = c + 1 THEN 0 END), 6) AS growing, count(*) FILTER (c2 = c + 1) AS steps FROM (SELECT *, lead(c) OVER w AS c2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM spiral WINDOW w AS (PARTITION BY m, r ORDER BY c)) GROUP BY 1")
def e4(t):
    s = gr.neighbours(t.spiral.withColumn("p", F.struct("x", "y")), ["m"], "r", "c", "p").where("right is not null")
    turn = (F.col("x") - 1000) * (F.col("right.y") - 1000) - (F.col("y") - 1000) * (F.col("right.x") - 1000)
    return s.groupBy("m").agg(r6(F.avg((turn > 0).cast("double"))).alias("growing"), F.count("*").alias("steps"))


@query("e7_region_code", views="boxes", sql="SELECT ((bmin_z::BIGINT // 64) << 20) | ((bmin_y::BIGINT // 64) << 10) | (bmin_x::BIGINT // 64) AS code, count(*) AS n FROM boxes GROUP BY 1")
def e7(t):
    part = lambda a: F.floor(F.col(f"bmin_{a}") / 64)
    return t.boxes.groupBy(F.shiftleft(part("z"), 20).bitwiseOR(F.shiftleft(part("y"), 10)).bitwiseOR(part("x")).alias("code")).agg(F.count("*").alias("n"))


@query("e9_zoverlap", views="spiral", sql="WITH e AS (SELECT m, min(y) AS lo, max(y) AS hi FROM spiral GROUP BY 1) SELECT a.m AS a, b.m AS b, round(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (a.hi - a.lo), 6) AS share FROM e a JOIN e b ON b.m = a.m + 1")
def e9(t):
    e = t.spiral.groupBy("m").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    b = e.select((F.col("m") - 1).alias("m"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return e.join(b, "m").select(F.col("m").alias("a"), (F.col("m") + 1).alias("b"), r6(F.greatest(F.lit(0.0), F.least("hi", "hi2") - F.greatest("lo", "lo2")) / (F.col("hi") - F.col("lo"))).alias("share"))


@query("e10_overlap_report", views="spiral", sql=f"""
WITH {_AB}, p AS (SELECT a.m, a.r, a.c, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d2 FROM a JOIN b ON b.z BETWEEN a.z - 60 AND a.z + 60 AND b.x BETWEEN a.x - 60 AND a.x + 60 AND b.y BETWEEN a.y - 60 AND a.y + 60 GROUP BY 1, 2, 3 HAVING min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 3600)
SELECT m, count(*) AS matched, round(median(sqrt(d2)), 4) AS median_gap, count(*) FILTER (sqrt(d2) <= 40.5) AS close FROM p GROUP BY 1""")
def e10(t):
    n = sp.nearest_join(t.spiral.where("m % 2 = 0"), t.spiral.where("m % 2 = 1"), ["x", "y", "z"], ["m", "r", "c"], 60.0, ["z"])
    return n.groupBy("m").agg(F.count("*").alias("matched"), F.round(F.percentile("distance", F.lit(0.5)), 4).alias("median_gap"), F.count_if(F.col("distance") <= 40.5).alias("close"))


@query("u3_mesh_diff", views="spiral", sql="""
WITH o AS (SELECT * FROM spiral WHERE (r + c) % 11 <> 0), n AS (SELECT m, r, c, x + CASE WHEN c % 10 = 0 THEN 5 ELSE 0 END AS x, y, z FROM spiral WHERE (r * 2 + c) % 13 <> 0)
SELECT coalesce(o.m, n.m) AS m, count(*) FILTER (o.m IS NULL) AS added, count(*) FILTER (n.m IS NULL) AS removed, count(*) FILTER (abs(o.x - n.x) > 1) AS moved, count(*) FILTER (abs(o.x - n.x) <= 1) AS same FROM o FULL JOIN n ON o.m = n.m AND o.r = n.r AND o.c = n.c GROUP BY 1""")
def u3(t):
    o = t.spiral.where("(r + c) % 11 <> 0").select("m", "r", "c", F.col("x").alias("ox"))
    n = t.spiral.where("(r * 2 + c) % 13 <> 0").select("m", "r", "c", (F.col("x") + F.when(F.col("c") % 10 == 0, 5).otherwise(0)).alias("nx"))
    moved = F.abs(F.col("ox") - F.col("nx")) > 1
    return o.join(n, ["m", "r", "c"], "full_outer").groupBy("m").agg(F.count_if(F.col("ox").isNull()).alias("added"), F.count_if(F.col("nx").isNull()).alias("removed"), F.count_if(moved).alias("moved"), F.count_if(~moved).alias("same"))


@query("a25_seam_switches", views="spiral", sql="""
WITH v AS (SELECT m, r, c, floor(sqrt((x - 1000) ** 2 + (y - 1000) ** 2) / 40)::INT AS j, m + CASE WHEN c > 120 THEN 1 ELSE 0 END AS k FROM spiral), d AS (SELECT *, j - k AS d, c // 12 AS cell FROM v),
n AS (SELECT cell, d, count(*) AS n FROM d GROUP BY 1, 2), o AS (SELECT cell, d AS mode, row_number() OVER (PARTITION BY cell ORDER BY n DESC, d) AS rn FROM n), e AS (SELECT d.m, d.r, d.c, d.d - o.mode AS e FROM d JOIN o ON o.cell = d.cell AND rn = 1),
p AS (SELECT a.e AS e1, b.e AS e2 FROM e a JOIN e b ON a.m = b.m AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)))
SELECT count(*) AS pairs, round(1000 * count(*) FILTER (e1 <> e2) / count(*)::DOUBLE, 6) AS per_1000, round((SELECT avg(CASE WHEN e <> 0 THEN 1 ELSE 0 END) FROM e), 6) AS wrong_area FROM p""")
def a25(t):
    v = t.spiral.select("m", "r", "c", (F.floor(F.sqrt((F.col("x") - 1000) ** 2 + (F.col("y") - 1000) ** 2) / 40) - F.col("m") - F.when(F.col("c") > 120, 1).otherwise(0)).cast("int").alias("d"), F.floor(F.col("c") / 12).alias("cell"))
    e = v.join(gr.mode_per(v, ["cell"], "d"), "cell").select("m", "r", "c", (F.col("d") - F.col("mode")).alias("e"))
    n = gr.neighbours(e, ["m"], "r", "c", "e")
    pairs = F.count("right") + F.count("below")
    switches = F.count_if(F.col("right") != F.col("e")) + F.count_if(F.col("below") != F.col("e"))
    return n.agg(pairs.alias("pairs"), r6(1000 * switches / pairs).alias("per_1000"), r6(F.avg((F.col("e") != 0).cast("double"))).alias("wrong_area"))


@query("t3_top_tiles", views="px", sql="""
WITH p AS (SELECT y, x, avg(v / CAST(255 AS DOUBLE)) AS p FROM px GROUP BY 1, 2 HAVING count(*) = 3), t AS (SELECT y // 8 AS ty, x // 8 AS tx, round(avg(4 * p * (1 - p)), 9) AS s, count(*) AS n FROM p GROUP BY 1, 2)
SELECT ty, tx, round(s, 6) AS spread, n FROM t WHERE n >= 32 ORDER BY s DESC, ty, tx LIMIT 10""")
def t3(t):
    p = t.px.groupBy("y", "x").agg(F.avg(F.col("v") / 255.0).alias("p"), F.count("*").alias("k")).where("k = 3")
    tile = lambda c: F.floor(F.col(c) / 8).cast("int")
    tiles = p.groupBy(tile("y").alias("ty"), tile("x").alias("tx")).agg(F.round(F.avg(4 * F.col("p") * (1 - F.col("p"))), 9).alias("s"), F.count("*").alias("n")).where("n >= 32")
    return tiles.orderBy(F.desc("s"), "ty", "tx").limit(10).select("ty", "tx", r6("s").alias("spread"), "n")


@query("t7_ensemble", views="px", sql="""
SELECT y, x, round(max(v) FILTER (map_id = 0) * CAST(0.5 AS DOUBLE) + max(v) FILTER (map_id = 1) * CAST(0.3 AS DOUBLE) + max(v) FILTER (map_id = 2) * CAST(0.2 AS DOUBLE), 6) AS v FROM px WHERE v <> 0 GROUP BY 1, 2 HAVING count(*) = 3""")
def t7(t):
    w = F.when(F.col("map_id") == 0, 0.5).when(F.col("map_id") == 1, 0.3).otherwise(0.2)
    return t.px.where("v <> 0").groupBy("y", "x").agg(F.sum(F.col("v") * w).alias("s"), F.count("*").alias("n")).where("n = 3").select("y", "x", r6("s").alias("v"))


@query("t11_z_ensemble", views="px", sql="WITH s AS (SELECT map_id, avg(v) AS m, stddev_pop(v) AS d FROM px GROUP BY 1) SELECT y, x, round(avg((v - m) / d), 6) AS z, round(avg(CASE WHEN v >= 128 THEN 1 ELSE 0 END), 6) AS stability FROM px JOIN s USING (map_id) GROUP BY 1, 2")
def t11(t):
    s = t.px.groupBy("map_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))  # three maps
    return t.px.join(F.broadcast(s), "map_id").groupBy("y", "x").agg(r6(F.avg((F.col("v") - F.col("m")) / F.col("d"))).alias("z"), r6(F.avg((F.col("v") >= 128).cast("double"))).alias("stability"))


@query("t10_decimate", views="spiral", sql="WITH k AS (SELECT m, ceil(sqrt(count(*) / CAST(300 AS DOUBLE)))::INT AS k FROM spiral GROUP BY 1) SELECT m, r, c FROM spiral JOIN k USING (m) WHERE r % k = 0 AND c % k = 0")
def t10(t):
    k = t.spiral.groupBy("m").agg(F.ceil(F.sqrt(F.count("*") / 300.0)).cast("int").alias("k"))
    return t.spiral.join(k, "m").where("r % k = 0 and c % k = 0").select("m", "r", "c")


@query("q1_pyramid", sql="""
WITH l AS (SELECT p_brand AS store, p_size % 5 AS level, max(p_size) AS size FROM part GROUP BY 1, 2) SELECT a.store, a.level, a.size, (b.size + (1 << a.level) - 1) // (1 << a.level) AS expected, CASE WHEN a.size < (b.size + (1 << a.level) - 1) // (1 << a.level) THEN 'missing' WHEN a.size > (b.size + (1 << a.level) - 1) // (1 << a.level) THEN 'extra' ELSE 'ok' END AS kind FROM l a JOIN l b ON a.store = b.store AND b.level = 0""")
def q1(t):
    lv = t.part.groupBy(F.col("p_brand").alias("store"), (F.col("p_size") % 5).alias("level")).agg(F.max("p_size").alias("size"))
    base = lv.where("level = 0").select("store", F.col("size").alias("full"))
    j = lv.join(base, "store").withColumn("expected", F.expr("(full + shiftleft(1, level) - 1) div shiftleft(1, level)").cast("int"))
    return j.select("store", "level", "size", "expected", F.when(F.col("size") < F.col("expected"), "missing").when(F.col("size") > F.col("expected"), "extra").otherwise("ok").alias("kind"))


@query("q5_plant_recall", sql="""
WITH c AS (SELECT p_type AS kind, count(*) FILTER (p_size > 40) AS planted, count(*) FILTER (p_size > 40 AND p_retailprice > 1000) AS caught, count(*) FILTER (p_size <= 40 AND p_retailprice > 1000) AS false_flags FROM part GROUP BY 1) SELECT *, round(caught / planted::DOUBLE, 6) AS recall FROM c""")
def q5(t):
    planted, fired = F.col("p_size") > 40, F.col("p_retailprice") > 1000
    c = t.part.groupBy(F.col("p_type").alias("kind")).agg(F.count_if(planted).alias("planted"), F.count_if(planted & fired).alias("caught"), F.count_if(~planted & fired).alias("false_flags"))
    return c.withColumn("recall", r6(F.col("caught") / F.col("planted")))


@query("q6_contract", sql="""
SELECT l_suppkey, concat_ws(',', CASE WHEN NOT (min(l_discount) >= 0 AND max(l_discount) <= 0.1) THEN 'share' END, CASE WHEN count(DISTINCT l_returnflag) <> 3 THEN 'bins' END, CASE WHEN NOT (avg(l_tax) < 0.041) THEN 'holds' END) AS violations FROM lineitem GROUP BY 1""")
def q6(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.countDistinct("l_returnflag").alias("bins"), F.avg("l_tax").alias("tax"))
    broken = [F.when(~((F.col("lo") >= 0) & (F.col("hi") <= 0.1)), "share"), F.when(F.col("bins") != 3, "bins"), F.when(~(F.round("tax", 12) < 0.041), "holds")]  # a mean of 0.041 may come out a little below it
    return g.select("l_suppkey", F.concat_ws(",", *broken).alias("violations"))
