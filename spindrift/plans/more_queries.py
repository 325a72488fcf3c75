"""Further queries: mesh reports, windows, hold-outs, chains and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..operators import graph as g
from ..operators import grids as gr
from ..operators import resampling as rs
from ..operators import stats as st
from ..operators import vectors as vc
from ..operators.stats import r6
from ..sources import files as fl
from .registry import query


@query("a12_sheet_check", views="px", sql="""
WITH w AS (SELECT y, x, max(ink) FILTER (map_id = 0) AS ink, max(v) FILTER (map_id = 0) AS a, max(v) FILTER (map_id = 1) AS b, max(v) FILTER (map_id = 2) AS c FROM px GROUP BY 1, 2 HAVING count(*) = 3), t AS (SELECT quantile_cont(a, 0.95) AS cut FROM w)
SELECT round(corr(a, b), 6) AS r1, round(corr(a, c), 6) AS r2, round(avg(ink) FILTER (a >= cut) / avg(ink), 6) AS enrichment, CASE WHEN avg(ink) FILTER (a >= cut) / avg(ink) > 1.2 AND abs(corr(a, b)) < 0.5 THEN 'on_sheet' ELSE 'unclear' END AS verdict FROM w, t""")
def a12(t):
    wide = t.px.groupBy("y", "x").agg(*[F.max(F.when(F.col("map_id") == i, F.col("v"))).alias(n) for i, n in enumerate("abc")], F.max(F.when(F.col("map_id") == 0, F.col("ink"))).alias("ink"), F.count("*").alias("n")).where("n = 3")
    both = wide.join(F.broadcast(wide.agg(F.percentile("a", F.lit(0.95)).alias("cut"))))  # one row
    rich = F.avg(F.when(F.col("a") >= F.col("cut"), F.col("ink"))) / F.avg("ink")
    return both.agg(r6(F.corr("a", "b")).alias("r1"), r6(F.corr("a", "c")).alias("r2"), r6(rich).alias("enrichment"), F.when((rich > 1.2) & (F.abs(F.corr("a", "b")) < 0.5), "on_sheet").otherwise("unclear").alias("verdict"))


@query("a15_top_people", views="feed", sql="""
WITH w AS (SELECT who, source, date_trunc('day', ts) AS day, max(score) AS best, count(*) AS items FROM feed GROUP BY 1, 2, 3) SELECT who, sum(best)::BIGINT AS total, count(*) AS works, sum(items)::BIGINT AS items FROM w GROUP BY 1 ORDER BY total DESC, who LIMIT 20""")
def a15(t):
    works = t.feed.groupBy("who", "source", F.date_trunc("day", "ts").alias("day")).agg(F.max("score").alias("best"), F.count("*").alias("items"))
    return works.groupBy("who").agg(F.sum("best").alias("total"), F.count("*").alias("works"), F.sum("items").alias("items")).orderBy(F.desc("total"), "who").limit(20)


_OFF = "d AS (SELECT m, r, c, (floor((sqrt((x - 1000) ** 2 + (y - 1000) ** 2) - 2000) / 40) - m)::INT AS d FROM spiral)"


@query("a27_winding_score", views="spiral", sql=f"""
WITH {_OFF}, n AS (SELECT d, count(*) AS n FROM d GROUP BY 1), b AS (SELECT d FROM n ORDER BY n DESC, d LIMIT 1)
SELECT d.m, count(*) AS n, round(avg(CASE WHEN d.d = b.d THEN 1 ELSE 0 END), 6) AS share, count(*) FILTER (abs(d.d - b.d) = 1) AS off_by_one FROM d, b GROUP BY 1""")
def a27(t):
    off = (F.floor((F.sqrt((F.col("x") - 1000) ** 2 + (F.col("y") - 1000) ** 2) - 2000) / 40) - F.col("m")).cast("int")
    d = t.spiral.select("m", off.alias("d"))
    best = gr.mode_per(d, [], "d")
    both = d.join(F.broadcast(best))  # one row
    return both.groupBy("m").agg(F.count("*").alias("n"), r6(F.avg((F.col("d") == F.col("mode")).cast("double"))).alias("share"), F.count_if(F.abs(F.col("d") - F.col("mode")) == 1).alias("off_by_one"))


_EDGES = "e AS (SELECT p.m, p.r, p.c, (a.x-p.x)**2 + (a.y-p.y)**2 + (a.z-p.z)**2 AS ee, (b.x-p.x)**2 + (b.y-p.y)**2 + (b.z-p.z)**2 AS gg, (a.x-p.x)*(b.x-p.x) + (a.y-p.y)*(b.y-p.y) + (a.z-p.z)*(b.z-p.z) AS ff FROM spiral p JOIN spiral a ON a.m = p.m AND a.r = p.r AND a.c = p.c + 1 JOIN spiral b ON b.m = p.m AND b.r = p.r + 1 AND b.c = p.c)"


def _metric(t):
    n = gr.neighbours(t.spiral.withColumn("p", F.struct("x", "y", "z")), ["m"], "r", "c", "p").where("right is not null and below is not null")
    u, v = gr.minus("right", "p"), gr.minus("below", "p")
    return n.select("m", "r", "c", gr.dot(u, u).alias("ee"), gr.dot(v, v).alias("gg"), gr.dot(u, v).alias("ff"))


@query("a30_isometry", views="spiral", sql=f"""
WITH {_EDGES}, s AS (SELECT m, round(sqrt((ee / 11000 + gg / 100) / 2), 4) AS l2, sqrt(ee * gg - ff * ff) / 2 AS area FROM e), h AS (SELECT m, l2, sum(area) AS area FROM s GROUP BY 1, 2), w AS (SELECT *, sum(area) OVER (PARTITION BY m ORDER BY l2) AS upto, sum(area) OVER (PARTITION BY m) AS total FROM h)
SELECT m, min(l2) FILTER (upto >= total / 2 - 1e-9) AS median_l2, round(max(l2), 4) AS max_l2 FROM w GROUP BY 1""")
def a30(t):
    s = _metric(t).select("m", F.round(F.sqrt((F.col("ee") / 11000 + F.col("gg") / 100) / 2), 4).alias("l2"), (F.sqrt(F.col("ee") * F.col("gg") - F.col("ff") * F.col("ff")) / 2).alias("area"))
    h = s.groupBy("m", "l2").agg(F.sum("area").alias("area"))
    total = h.groupBy("m").agg(F.sum("area").alias("total"))
    w = st.running(h, ["m"], "l2", ["area"]).join(total, "m")
    return w.groupBy("m").agg(F.min(F.when(F.col("area_before") + F.col("area") >= F.col("total") / 2 - 1e-9, F.col("l2"))).alias("median_l2"), F.round(F.max("l2"), 4).alias("max_l2"))


@query("e2_grid_geometry", views="spiral", sql=f"WITH {_EDGES} SELECT m, count(*) AS nodes, round(avg(sqrt(ee)), 4) AS edge_u, round(avg(sqrt(gg)), 4) AS edge_v, round(sum(sqrt(ee * gg - ff * ff)), 2) AS area FROM e GROUP BY 1")
def e2(t):
    return _metric(t).groupBy("m").agg(F.count("*").alias("nodes"), F.round(F.avg(F.sqrt("ee")), 4).alias("edge_u"), F.round(F.avg(F.sqrt("gg")), 4).alias("edge_v"), F.round(F.sum(F.sqrt(F.col("ee") * F.col("gg") - F.col("ff") * F.col("ff"))), 2).alias("area"))


@query("g3_mesh_check", views="spiral", sql=f"""
WITH {_EDGES}, q AS (SELECT m, median(sqrt(ee)) AS mu FROM e GROUP BY 1) SELECT e.m, count(*) AS nodes, count(*) FILTER (sqrt(ee) > mu * 1.0005 OR sqrt(ee) < mu / 1.0005) AS stretched, count(*) FILTER (sqrt(ee) > mu * 1.0005 OR sqrt(ee) < mu / 1.0005) = 0 AS clean FROM e JOIN q USING (m) GROUP BY 1""")
def g3(t):
    e = _metric(t).select("m", F.sqrt("ee").alias("u"))
    mid = e.groupBy("m").agg(F.percentile("u", F.lit(0.5)).alias("mu"))
    bad = F.count_if((F.col("u") > F.col("mu") * 1.0005) | (F.col("u") < F.col("mu") / 1.0005))
    return e.join(mid, "m").groupBy("m").agg(F.count("*").alias("nodes"), bad.alias("stretched"), (bad == 0).alias("clean"))


@query("w8_height_coverage", views="spiral", sql="""
WITH b AS (SELECT DISTINCT m, r, c // 6 AS b FROM spiral WHERE c < 120 AND (c + r) % 7 <> 0), n AS (SELECT m, r, b, coalesce(lead(b) OVER w, first(b) OVER w + 20) AS nx FROM b WINDOW w AS (PARTITION BY m, r ORDER BY b))
SELECT m, r, round(count(*) / CAST(20 AS DOUBLE), 6) AS share, max(nx - b - 1) * 18 AS largest_arc_deg FROM n GROUP BY 1, 2""")
def w8(t):
    b = t.spiral.where("c < 120 and (c + r) % 7 <> 0").select("m", "r", F.floor(F.col("c") / 6).cast("int").alias("b"))
    arc = gr.largest_arc(b, ["m", "r"], "b", 20)
    return arc.select("m", "r", r6(F.col("bins") / 20.0).alias("share"), (F.col("largest_arc") * 18).alias("largest_arc_deg"))


@query("w13_longest_series", sql="""
WITH d AS (SELECT DISTINCT o_custkey AS g, o_orderkey // 300 AS p FROM orders), i AS (SELECT g, p, p - row_number() OVER (PARTITION BY g ORDER BY p) AS k FROM d), s AS (SELECT g, k, min(p) AS start, count(*) AS n FROM i GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, start) AS rn FROM s) SELECT g, start, n FROM r WHERE rn = 1""")
def w13(t):
    d = t.orders.select(F.col("o_custkey").alias("g"), F.floor(F.col("o_orderkey") / 300).alias("p")).distinct()
    i = d.withColumn("k", F.col("p") - F.row_number().over(W.partitionBy("g").orderBy("p")))
    s = i.groupBy("g", "k").agg(F.min("p").alias("start"), F.count("*").alias("n"))
    return s.groupBy("g").agg(F.max_by(F.struct("start", "n"), F.struct("n", (-F.col("start")).alias("o"))).alias("b")).select("g", "b.start", "b.n")


@query("w14_turn_overlap", views="spiral", sql="""
SELECT a.m, a.r, count(*) AS columns, round(median(sqrt((b.x - 1000) ** 2 + (b.y - 1000) ** 2) - sqrt((a.x - 1000) ** 2 + (a.y - 1000) ** 2)), 4) AS step FROM spiral a JOIN spiral b ON a.m = b.m AND a.r = b.r AND b.c = a.c + 120 GROUP BY 1, 2""")
def w14(t):
    rad = F.sqrt((F.col("x") - 1000) ** 2 + (F.col("y") - 1000) ** 2)
    a = t.spiral.select("m", "r", "c", rad.alias("inner"))
    b = t.spiral.select("m", "r", (F.col("c") - 120).alias("c"), rad.alias("outer"))
    return a.join(b, ["m", "r", "c"]).groupBy("m", "r").agg(F.count("*").alias("columns"), F.round(F.percentile(F.col("outer") - F.col("inner"), F.lit(0.5)), 4).alias("step"))


@query("w19_robust_axis", sql="""
WITH p AS (SELECT s_suppkey AS z, s_acctbal AS v FROM supplier), s AS (SELECT c.z AS c, i.z AS i, median((j.v - i.v) / (j.z - i.z)) AS s FROM p c JOIN p i ON i.z BETWEEN c.z - 4 AND c.z + 4 JOIN p j ON j.z BETWEEN c.z - 4 AND c.z + 4 AND j.z <> i.z GROUP BY 1, 2) SELECT c AS z, round(median(s), 6) AS slope FROM s GROUP BY 1""")
def w19(t):
    p = t.supplier.select(F.col("s_suppkey").alias("z"), F.col("s_acctbal").alias("v"))
    near = p.withColumn("c", F.explode(F.sequence(F.col("z") - 4, F.col("z") + 4))).join(p.select(F.col("z").alias("c")), "c")  # each point once for each centre within reach
    i, j = near.alias("i"), near.alias("j")
    pair = i.join(j, (F.col("i.c") == F.col("j.c")) & (F.col("i.z") != F.col("j.z"))).select(F.col("i.c").alias("c"), F.col("i.z").alias("z"), ((F.col("j.v") - F.col("i.v")) / (F.col("j.z") - F.col("i.z"))).alias("s"))
    inner = pair.groupBy("c", "z").agg(F.percentile("s", F.lit(0.5)).alias("s"))
    return inner.groupBy(F.col("c").alias("z")).agg(r6(F.percentile("s", F.lit(0.5))).alias("slope"))


@query("w22_largest_square", views="px", sql="""
WITH m AS (SELECT map_id, y, x, x - row_number() OVER (PARTITION BY map_id, y ORDER BY x) AS island FROM px WHERE v >= 20),
r AS (SELECT map_id, y, x, count(*) OVER (PARTITION BY map_id, y, island ORDER BY x DESC) AS run FROM m),
f AS (SELECT a.map_id, a.y, a.x, b.y - a.y + 1 AS s, min(b.run) OVER w AS low, count(*) OVER w AS n FROM r a JOIN r b ON b.map_id = a.map_id AND b.x = a.x AND b.y BETWEEN a.y AND a.y + a.run - 1 WINDOW w AS (PARTITION BY a.map_id, a.y, a.x ORDER BY b.y)),
k AS (SELECT map_id, s FROM f WHERE n = s AND low >= s), best AS (SELECT map_id, max(s) AS side FROM k GROUP BY 1)
SELECT map_id, side, count(*) AS squares FROM best JOIN k USING (map_id) WHERE s = side GROUP BY 1, 2""")
def w22(t):
    return gr.largest_square(t.px.where("v >= 20"))


@query("t6_suggest_margin", views="px", sql="""
WITH p AS (SELECT y, x, greatest(0, 1 - 2 * abs(avg(v / CAST(255 AS DOUBLE)) - CAST(0.5 AS DOUBLE))) AS s, stddev_pop(v / CAST(255 AS DOUBLE)) AS d FROM px GROUP BY 1, 2 HAVING count(*) = 3 AND count(*) FILTER (v <> 0) > 0)
SELECT y // 16 AS ty, x // 16 AS tx, round(avg(s), 6) AS margin, round(avg(d), 6) AS spread, count(*) >= 128 AS enough FROM p GROUP BY 1, 2""")
def t6(t):
    v = F.col("v") / 255.0
    p = t.px.groupBy("y", "x").agg(F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.avg(v) - 0.5)).alias("s"), F.stddev_pop(v).alias("d"), F.count("*").alias("n"), F.count_if(F.col("v") != 0).alias("u")).where("n = 3 and u > 0")
    tile = lambda c: F.floor(F.col(c) / 16).cast("int")
    return p.groupBy(tile("y").alias("ty"), tile("x").alias("tx")).agg(r6(F.avg("s")).alias("margin"), r6(F.avg("d")).alias("spread"), (F.count("*") >= 128).alias("enough"))


@query("u10_holdout_split", views="px", sql="""
WITH b AS (SELECT DISTINCT y // 8 AS ky, x // 8 AS kx FROM px), h AS (SELECT ky, kx, row_number() OVER (ORDER BY md5(ky || '|' || kx || '|3'), ky, kx) <= floor((SELECT count(*) FROM b) * CAST(0.1 AS DOUBLE)) AS held FROM b),
p AS (SELECT y // 4 AS py, x // 4 AS px_, avg(sup) AS support FROM px WHERE map_id = 0 GROUP BY 1, 2)
SELECT count(*) AS patches, count(*) FILTER (support >= 0.05) AS supported, count(*) FILTER (support >= 0.05 AND NOT EXISTS (SELECT 1 FROM h WHERE held AND ky BETWEEN py // 2 - 1 AND py // 2 + 1 AND kx BETWEEN px_ // 2 - 1 AND px_ // 2 + 1)) AS training, (SELECT count(*) FROM h WHERE held) AS held_blocks FROM p""")
def u10(t):
    cell = lambda c, k: F.floor(F.col(c) / k).cast("int")
    b = t.px.select(cell("y", 8).alias("by"), cell("x", 8).alias("bx")).distinct()
    order = F.md5(F.concat_ws("|", F.col("by").cast("string"), F.col("bx").cast("string"), F.lit("3")))
    n = b.count() // 10  # blocks of the grid, not pixels
    held = g.written(rs.smallest_by_hash(b, n, order, ["by", "bx"]), "held")
    guard = held.withColumn("by", F.explode(F.sequence(F.col("by") - 1, F.col("by") + 1))).withColumn("bx", F.explode(F.sequence(F.col("bx") - 1, F.col("bx") + 1))).distinct().withColumn("near", F.lit(True))
    p = t.px.where("map_id = 0").groupBy(cell("y", 4).alias("py"), cell("x", 4).alias("qx")).agg(F.avg("sup").alias("support"))
    p = p.withColumns({"by": cell("py", 2), "bx": cell("qx", 2)}).join(guard, ["by", "bx"], "left")
    good = F.col("support") >= 0.05
    return p.agg(F.count("*").alias("patches"), F.count_if(good).alias("supported"), F.count_if(good & F.col("near").isNull()).alias("training")).withColumn("held_blocks", F.lit(n).cast("long"))


@query("g5_forest_unwrap", views="px", sql="""
WITH RECURSIVE n AS (SELECT y * 64 + x AS id, y, x, v FROM px WHERE map_id = 2 AND v >= 110), p AS (SELECT n.id, n.v, coalesce(l.id, u.id) AS parent FROM n LEFT JOIN n l ON l.y = n.y AND l.x = n.x - 1 LEFT JOIN n u ON u.x = n.x AND u.y = n.y - 1),
w(id, cur) AS (SELECT id, id FROM p UNION ALL SELECT w.id, p.parent FROM w JOIN p ON p.id = w.cur WHERE p.parent IS NOT NULL), r AS (SELECT w.id, w.cur AS root FROM w JOIN p ON p.id = w.cur WHERE p.parent IS NULL)
SELECT root, count(*) AS n, sum(a.v - b.v)::BIGINT AS climb FROM r JOIN p a ON a.id = r.id JOIN p b ON b.id = r.root GROUP BY 1""")
def g5(t):
    n = t.px.where("map_id = 2 and v >= 110").select((F.col("y") * 64 + F.col("x")).alias("id"), "y", "x", "v")
    left = n.select(F.col("id").alias("l"), F.col("v").alias("lv"), "y", (F.col("x") + 1).alias("x"))
    up = n.select(F.col("id").alias("u"), F.col("v").alias("uv"), (F.col("y") + 1).alias("y"), "x")
    p = n.join(left, ["y", "x"], "left").join(up, ["y", "x"], "left")
    tree = g.written(p.select("id", F.coalesce("l", "u", "id").alias("root"), (F.col("v") - F.coalesce("lv", "uv", "v")).cast("long").alias("climb")), "forest")
    while True:  # pointer doubling until all stand at a root
        up_ = tree.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("climb").alias("c2"))
        moved = tree.join(up_, "root").select("id", F.col("r2").alias("root"), (F.col("climb") + F.when(F.col("id") == F.col("root"), 0).otherwise(F.col("c2"))).alias("climb"), (F.col("r2") != F.col("root")).alias("moved"))
        moved = g.written(moved, "forest")
        tree = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return tree.groupBy("root").agg(F.count("*").alias("n"), F.sum("climb").alias("climb"))


_M1, _M2 = ((0.5, 0.1, 3.0), (-0.2, 0.9, -7.0)), ((1.5, 0.0, 1.0), (0.3, 1.1, 2.0))


@query("g7_apply_chain", views="spiral", sql="SELECT m, r, c, round(1.5 * (0.5 * x + 0.1 * y + 3) + 1, 6) AS u, round(0.3::DOUBLE * (0.5 * x + 0.1 * y + 3) + 1.1::DOUBLE * (-0.2 * x + 0.9 * y - 7) + 2, 6) AS v FROM spiral".replace("0.5 * x", "0.5::DOUBLE * x").replace("0.1 * y", "0.1::DOUBLE * y").replace("-0.2 * x", "-0.2::DOUBLE * x").replace("0.9 * y", "0.9::DOUBLE * y"))
def g7(t):
    point = (F.col("x"), F.col("y"))
    for m in (_M1, _M2):
        point = tuple(a * point[0] + b * point[1] + k for a, b, k in m)
    return t.spiral.select("m", "r", "c", r6(point[0]).alias("u"), r6(point[1]).alias("v"))


@query("p11_region_inside", views="boxes", sql="""
SELECT family, count(*) FILTER (2 * bmin_x - 100 >= 0 AND 2 * bmax_x - 100 <= 1500 AND bmin_y + 10 >= 0 AND bmax_y + 10 <= 800) AS inside, count(*) FILTER (2 * bmax_x - 100 >= 0 AND 2 * bmin_x - 100 <= 1500 AND bmax_y + 10 >= 0 AND bmin_y + 10 <= 800) AS touches FROM boxes GROUP BY 1""")
def p11(t):
    corner = lambda x, y: (2 * F.col(f"{x}_x") - 100, F.col(f"{y}_y") + 10)
    corners = [corner(x, y) for x in ("bmin", "bmax") for y in ("bmin", "bmax")]
    inside = reduce(lambda a, b: a & b, [x.between(0, 1500) & y.between(0, 800) for x, y in corners])
    xs, ys = [x for x, _ in corners], [y for _, y in corners]
    touches = (F.greatest(*xs) >= 0) & (F.least(*xs) <= 1500) & (F.greatest(*ys) >= 0) & (F.least(*ys) <= 800)
    return t.boxes.groupBy("family").agg(F.count_if(inside).alias("inside"), F.count_if(touches).alias("touches"))


@query("q2_scale_check", sql="SELECT l_suppkey, round(avg(l_quantity), 6) AS pitch, abs(avg(l_quantity) / 25.5 - 1) > 0.01 AS off FROM lineitem GROUP BY 1")
def q2(t):
    return t.lineitem.groupBy("l_suppkey").agg(r6(F.avg("l_quantity")).alias("pitch"), (F.abs(F.avg("l_quantity") / 25.5 - 1) > 0.01).alias("off"))


@query("q3_label_shapes", sql="""
WITH a AS (SELECT l_orderkey AS id, max(l_partkey) AS w, max(l_suppkey) AS h FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS id, o_custkey AS w2 FROM orders) SELECT id, CASE WHEN b.id IS NULL THEN 'missing' WHEN abs(w - w2) > 0.5 * greatest(w, w2) THEN 'drift' ELSE 'ok' END AS kind FROM a LEFT JOIN b USING (id)""")
def q3(t):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_partkey").alias("w"))
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("w2"))
    drift = F.abs(F.col("w") - F.col("w2")) > 0.5 * F.greatest("w", "w2")
    return a.join(b, "id", "left").select("id", F.when(F.col("w2").isNull(), "missing").when(drift, "drift").otherwise("ok").alias("kind"))


@query("q4_canvas_audit", sql="""
WITH r AS (SELECT p_partkey, k, round(abs(p_retailprice / (p_size * 10.0::DOUBLE) - k), 9) AS res FROM part, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k)), b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY res, k) AS rn FROM r) SELECT p_partkey, k AS ratio, round(res, 6) AS residual FROM b WHERE rn = 1""")
def q4(t):
    tries = F.array(*[F.struct(F.round(F.abs(F.col("p_retailprice") / (F.col("p_size") * 10.0) - k), 9).alias("res"), F.lit(k).alias("ratio")) for k in (1, 2, 4, 8, 16, 32)])
    best = F.array_min(tries)
    return t.part.select("p_partkey", best["ratio"].alias("ratio"), r6(best["res"]).alias("residual"))


@query("s10_corpus", sql="""
WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages), d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'), '(?is)<footer[^>]*>.*?</footer>', ' ', 'g'), '(?is)<title[^>]*>.*?</title>', ' ', 'g') AS t FROM c),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM d),
l AS (SELECT page_id, trim(regexp_replace(upper(translate(t, 'ßàáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'saaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^A-Z]+', ' ', 'g')) AS line FROM e) SELECT page_id, md5(line) AS line_md5, length(line) AS n FROM l WHERE line <> ''""")
def s10(t):
    return fl.build_corpus(t.pages, "page_id", "html").select("page_id", F.md5("line").alias("line_md5"), F.length("line").alias("n"))


@query("e6_subtended", views="spiral", sql="""
WITH s AS (SELECT m, r, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(c) OVER w - c AS dc FROM spiral WINDOW w AS (PARTITION BY m, r ORDER BY c)), k AS (SELECT cx, cy FROM (SELECT unnest([960, 1000, 1040]) AS cx), (SELECT unnest([960, 1000, 1040]) AS cy)),
a AS (SELECT m, r, cx, cy, atan2(y2 - cy, x2 - cx) - atan2(y - cy, x - cx) AS d FROM s, k WHERE dc = 1) SELECT m, cx, cy, round(sum(abs(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END)) / (2 * pi()), 6) AS turns FROM a GROUP BY 1, 2, 3""")
def e6(t):
    s = gr.neighbours(t.spiral.withColumn("p", F.struct("x", "y")), ["m"], "r", "c", "p").where("right is not null")
    grid = F.array(*map(F.lit, (960, 1000, 1040)))
    a = s.withColumn("cx", F.explode(grid)).withColumn("cy", F.explode(grid))
    d = F.atan2(F.col("right.y") - F.col("cy"), F.col("right.x") - F.col("cx")) - F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))
    d = F.when(d > F.pi(), d - 2 * F.pi()).when(d < -F.pi(), d + 2 * F.pi()).otherwise(d)
    return a.groupBy("m", "cx", "cy").agg(r6(F.sum(F.abs(d)) / (2 * F.pi())).alias("turns"))


_FOLD = "trim(regexp_replace(upper(translate(text, 'ßàáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'saaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^A-Z]+', ' ', 'g'))"


@query("x11_locate", sql=f"""
WITH q AS (SELECT item_id, string_split({_FOLD}, ' ') AS w FROM benchmark), d AS (SELECT doc_id, string_split({_FOLD}, ' ') AS w FROM documents),
qg AS (SELECT item_id, len(w) AS n, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM q WHERE len(w) >= 3)), dg AS (SELECT doc_id, j, array_to_string(w[j:j + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS j FROM d WHERE len(w) >= 3)),
c AS (SELECT DISTINCT item_id, doc_id, greatest(1, j - i + 1) AS s, n FROM qg JOIN dg USING (g)), l AS (SELECT item_id, doc_id, s, levenshtein(array_to_string(q.w, ' '), array_to_string(d.w[s:s + n - 1], ' ')) AS distance FROM c JOIN q USING (item_id) JOIN d USING (doc_id)),
r AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS candidates, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id, s) AS k FROM l)
SELECT item_id, candidates, distance::INT AS distance, doc_id, (s - 1)::INT AS "start" FROM r WHERE k = 1""")
def x11(t):
    fold = lambda df, key: df.select(key, F.split(tx.letters_only(F.col("text")), " ").alias("w"))
    return tx.locate(fold(t.benchmark, "item_id"), fold(t.documents, "doc_id"), "item_id", "doc_id", 3)


@query("j7_missing_sector", sql="""
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 360 AS arc, o_custkey % 500 AS z, o_orderstatus AS s FROM orders), n AS (SELECT q.k, t.s FROM p q JOIN p t ON q.s = 'P' AND t.s <> 'P' AND t.z = q.z AND least(abs(t.arc - q.arc), 360 - abs(t.arc - q.arc)) <= 3)
SELECT k FROM n GROUP BY 1 HAVING count(*) FILTER (s = 'O') > 0 AND count(*) FILTER (s = 'F') = 0""")
def j7b(t):
    p = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 360).alias("arc"), (F.col("o_custkey") % 500).alias("z"), F.col("o_orderstatus").alias("s"))

    def reach(status):
        marks = p.where(F.col("s") == status).select("z", "arc").distinct()
        return marks.withColumn("arc", F.explode(F.sequence(F.col("arc") - 3, F.col("arc") + 3))).select("z", F.pmod("arc", F.lit(360)).alias("arc")).distinct()

    return p.where("s = 'P'").join(reach("O"), ["z", "arc"], "left_semi").join(reach("F"), ["z", "arc"], "left_anti").select("k")


@query("w5_flag_steps", views="px", sql="""
WITH r AS (SELECT *, (rank() OVER (PARTITION BY map_id ORDER BY v) + (count(*) OVER (PARTITION BY map_id, v) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY map_id) AS share FROM px), n AS (SELECT a.map_id, a.y, a.x, avg(b.v) AS near FROM px a JOIN px b ON b.map_id = a.map_id AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 GROUP BY 1, 2, 3)
SELECT map_id, count(*) FILTER (share > 0.95) AS by_rank, count(*) FILTER (v >= 250) AS by_value, count(*) FILTER (near > 160.01) AS by_near, count(*) FILTER (share > 0.95 OR v >= 250 OR near > 160.01) AS flagged FROM r JOIN n USING (map_id, y, x) GROUP BY 1""")
def w5(t):
    px = gr.written(t.px.select("map_id", "y", "x", "v", F.lit(1).alias("one")), "px")  # read three times
    near = gr.box_sums(px, ["map_id"], {"s": "v", "n": "one"}, 2)
    total = px.groupBy("map_id").agg(F.count("*").alias("total"))
    r = st.mid_rank(near, "v", ["map_id"]).join(total, "map_id")
    rank, value, around = F.col("rank") / F.col("total") > 0.95, F.col("v") >= 250, F.col("s") / F.col("n") > 160.01
    return r.groupBy("map_id").agg(F.count_if(rank).alias("by_rank"), F.count_if(value).alias("by_value"), F.count_if(around).alias("by_near"), F.count_if(rank | value | around).alias("flagged"))


@query("v4_ridge_head")
def v4(t):
    out = vc.ridge_out_of_fold(t.embeddings, "vec_id", "embedding", "label")
    return out.select("vec_id", "fold", F.round("predicted", 4).alias("predicted"))
