"""Queries of meshes as graphs: orientation, positions, linked components, sure pieces and ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets, spatial
from .registry import query

# neighbours in an order as overlapping meshes; every 29th pair contradicts the hidden signs
_PAIRS = """pr AS (SELECT a, b, count(*) AS matched, CASE WHEN (a * 7 + b) % 29 = 0 THEN -1 ELSE 1 END * (CASE WHEN a % 3 = 0 THEN -1 ELSE 1 END) * (CASE WHEN b % 3 = 0 THEN -1 ELSE 1 END) AS orient,
  (CASE WHEN b % 3 = 0 THEN -1 ELSE 1 END) * ((a - b) / CAST(4 AS DOUBLE) + ((a * 5 + b) % 7 - 3) / CAST(100 AS DOUBLE)) AS "offset", (a * 31 + b * 17) % 100 / CAST(100 AS DOUBLE) AS coverage
  FROM (SELECT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1) WHERE a % 4 = b % 4 AND a <> b GROUP BY a, b),
two AS (SELECT a, b, matched, orient FROM pr UNION ALL SELECT b, a, matched, orient FROM pr)"""
_SIGNS = f"""{_PAIRS}, w(id, root) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT two.b, w.root FROM w JOIN two ON two.a = w.id AND w.root < two.b),
comp AS (SELECT id, min(root) AS c FROM w GROUP BY 1), rt AS (SELECT c, max({{'area': s_acctbal, 'k': -id}}).k * -1 AS root FROM comp JOIN supplier ON s_suppkey = id GROUP BY 1),
bf(node, root, level) AS (SELECT root, root, 0 FROM rt UNION SELECT two.b, bf.root, bf.level + 1 FROM bf JOIN two ON two.a = bf.node WHERE bf.level < 12), lv AS (SELECT node, min(root) AS root, min(level) AS level FROM bf GROUP BY 1),
tree AS (SELECT lv.node, max({{'m': two.matched, 'k': -two.a, 'o': two.orient}}) AS up FROM lv JOIN two ON two.b = lv.node JOIN lv p ON p.node = two.a AND p.level = lv.level - 1 GROUP BY 1),
sg(node, s) AS (SELECT root, 1 FROM rt UNION ALL SELECT tree.node, sg.s * tree.up.o FROM sg JOIN tree ON sg.node = -tree.up.k),
tu AS (SELECT CASE WHEN sum(s * (CASE WHEN node % 3 = 0 THEN CAST(0.8 AS DOUBLE) ELSE CAST(-0.9 AS DOUBLE) END)) < 0 THEN -1 ELSE 1 END AS t FROM sg)"""


def _meshes(t):
    return t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("area"), F.when(F.col("s_suppkey") % 3 == 0, 0.8).otherwise(-0.9).alias("outward"))


def _pairs(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"))
    y = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    side = lambda k: F.when(F.col(k) % 3 == 0, -1).otherwise(1)
    p = x.join(y, ["l_orderkey", "l_linenumber"]).where("a % 4 = b % 4 and a <> b").groupBy("a", "b").agg(F.count("*").alias("matched"))
    orient = F.when((F.col("a") * 7 + F.col("b")) % 29 == 0, -1).otherwise(1) * side("a") * side("b")
    offset = side("b") * ((F.col("a") - F.col("b")) / 4.0 + ((F.col("a") * 5 + F.col("b")) % 7 - 3) / 100.0)
    return p.select("a", "b", "matched", orient.alias("orient"), offset.alias("offset"), ((F.col("a") * 31 + F.col("b") * 17) % 100 / 100.0).alias("coverage"))


@query("g10_orientation", sql=f"WITH RECURSIVE {_SIGNS} SELECT sg.node, lv.root, lv.level, sg.s * t AS sign FROM sg JOIN lv USING (node), tu")
def g10(t):
    return sheets.orient_meshes(_meshes(t), _pairs(t))[0].select("node", "root", "level", "sign")


@query("g10_conflicts", sql=f"""
WITH RECURSIVE {_SIGNS} SELECT root, count(*) AS nodes, coalesce(max(n), 0)::BIGINT AS conflicts FROM lv LEFT JOIN
(SELECT lv.root, count(*) AS n FROM pr JOIN sg x ON x.node = pr.a JOIN sg y ON y.node = pr.b JOIN lv ON lv.node = pr.a WHERE x.s * y.s <> pr.orient GROUP BY 1) USING (root) GROUP BY 1""")
def g10_conflicts(t):
    return sheets.orient_meshes(_meshes(t), _pairs(t))[1]


@query("g10_positions", sql=f"""
WITH RECURSIVE {_SIGNS}, eq AS (SELECT a, b, matched AS w, matched * s * t * "offset" AS wo FROM pr JOIN sg ON sg.node = pr.b, tu), e2 AS (SELECT a, b, w, wo FROM eq UNION ALL SELECT b, a, w, -wo FROM eq),
it(i, node, x) AS (SELECT 0, node, CAST(0 AS DOUBLE) FROM sg WHERE node IN (SELECT a FROM e2) UNION ALL SELECT any_value(me.i) + 1, e2.a, any_value(me.x) / 2 + sum(e2.w * it.x + e2.wo) / sum(e2.w) / 2 FROM it JOIN e2 ON e2.b = it.node JOIN it me ON me.node = e2.a WHERE it.i < 300 GROUP BY e2.a)
SELECT it.node, c.c AS component, round(it.x - z.x, 5) AS position FROM it JOIN comp c ON c.id = it.node JOIN it z ON z.node = c.c AND z.i = it.i WHERE it.i = 300""")
def g10_positions(t):
    pairs = _pairs(t)
    found = sheets.mesh_positions(pairs, sheets.orient_meshes(_meshes(t), pairs)[0])
    return found.select("node", "component", F.round("position", 5).alias("position"))


@query("g10_duplicates", sql=f"""
WITH RECURSIVE {_PAIRS}, cl AS (SELECT a, b FROM pr WHERE coverage >= CAST(0.96 AS DOUBLE)), c2 AS (SELECT a, b FROM cl UNION SELECT b, a FROM cl), w(id, root) AS (SELECT DISTINCT a, a FROM c2 UNION SELECT c2.b, w.root FROM w JOIN c2 ON c2.a = w.id AND w.root < c2.b),
c AS (SELECT id, min(root) AS c FROM w GROUP BY 1), k AS (SELECT c, max({{'area': s_acctbal, 'k': -id}}).k * -1 AS kept FROM c JOIN supplier ON s_suppkey = id GROUP BY 1) SELECT id AS node, kept FROM c JOIN k USING (c)""")
def g10_duplicates(t):
    return sheets.duplicate_groups(_meshes(t), _pairs(t), 0.96)


_OFFSETS = """p AS (SELECT CAST(m AS BIGINT) * 2640 + r * 132 + c AS id, m AS sheet, r, c, x, y, z, cos(c * pi() / 60) AS nx, sin(c * pi() / 60) AS ny, CASE WHEN c >= 66 + r % 5 THEN 8 ELSE 0 END + r * c % 3 * CAST(0.5 AS DOUBLE) AS off FROM spiral WHERE (r * 5 + c * 3 + m) % 23 <> 0)"""


def _points(t):
    angle = F.col("c") * F.pi() / 60
    off = F.when(F.col("c") >= 66 + F.col("r") % 5, 8.0).otherwise(0.0) + F.col("r") * F.col("c") % 3 * 0.5
    off = F.when((F.col("r") * 5 + F.col("c") * 3 + F.col("m")) % 23 != 0, off)
    return t.spiral.select((F.col("m").cast("long") * 2640 + F.col("r") * 132 + F.col("c")).alias("id"), F.col("m").alias("sheet"), "r", "c", "x", "y", "z", F.cos(angle).alias("nx"), F.sin(angle).alias("ny"), F.lit(0.0).alias("nz"), off.alias("off"))


@query("g12_linked", views="spiral", sql=f"""
WITH RECURSIVE {_OFFSETS}, q AS (SELECT *, x + off * nx AS cx, y + off * ny AS cy FROM p), st(dr, dc) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1)),
e AS (SELECT a.id AS a, b.id AS b FROM q a, st JOIN q b ON b.sheet = a.sheet AND b.r = a.r + dr AND b.c = a.c + dc WHERE abs((a.cx - b.cx) * (a.nx + b.nx) + (a.cy - b.cy) * (a.ny + b.ny)) <= 2 * sqrt((a.nx + b.nx) ** 2 + (a.ny + b.ny) ** 2)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT id, id FROM q), it(i, id, l) AS (SELECT 0, id, id FROM q UNION ALL SELECT any_value(it.i) + 1, e2.a, min(it.l) FROM it JOIN e2 ON e2.b = it.id WHERE it.i < 200 GROUP BY e2.a),
n AS (SELECT q.sheet, q.r, q.c, it.l AS component FROM it JOIN q USING (id) WHERE it.i = 200),
bx AS (SELECT m AS sheet, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM spiral GROUP BY 1), cells AS (SELECT sheet, unnest(range(r0, r1 + 1)) AS r, r0, r1, c0, c1 FROM bx), cl AS (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM cells),
em AS (SELECT sheet, r, c, sheet * 1000000 + r * 1000 + c AS id, r = r0 OR r = r1 OR c = c0 OR c = c1 AS edge FROM cl WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.sheet = cl.sheet AND n.r = cl.r AND n.c = cl.c)),
he AS (SELECT a.id AS a, b.id AS b FROM em a JOIN em b ON a.sheet = b.sheet AND abs(a.r - b.r) + abs(a.c - b.c) <= 1), hi(i, id, l) AS (SELECT 0, id, id FROM em UNION ALL SELECT any_value(hi.i) + 1, he.a, min(hi.l) FROM hi JOIN he ON he.b = hi.id WHERE hi.i < 40 GROUP BY he.a),
h AS (SELECT em.*, hi.l AS gap FROM hi JOIN em USING (id) WHERE hi.i = 40), sm AS (SELECT gap FROM h GROUP BY 1 HAVING count(*) <= 3 AND NOT bool_or(edge)), op AS (SELECT gap, sheet, r, c FROM h JOIN sm USING (gap)),
rim AS (SELECT DISTINCT gap, sheet, r + dr AS r, c + dc AS c FROM op, (VALUES (-1), (0), (1)) u(dr), (VALUES (-1), (0), (1)) v(dc)), ro AS (SELECT gap, sheet, r, c FROM rim EXCEPT SELECT gap, sheet, r, c FROM op),
one AS (SELECT gap, min(component) AS component FROM ro LEFT JOIN n USING (sheet, r, c) GROUP BY 1 HAVING count(*) FILTER (component IS NULL) = 0 AND min(component) = max(component)),
al AS (SELECT sheet, component, 0 AS f FROM n UNION ALL SELECT sheet, component, 1 FROM op JOIN one USING (gap)) SELECT sheet, component, count(*) FILTER (f = 0) AS points, count(*) FILTER (f = 1) AS filled FROM al GROUP BY 1, 2""")
def g12(t):
    found = sheets.linked_components(_points(t), 2.0, 3)
    return found.groupBy("sheet", "component").agg(F.count_if(~F.col("filled")).alias("points"), F.count_if("filled").alias("filled"))


# a wide bound joins the sheets across the jump at some columns: the bridge test finds the components that lie on both
@query("g12_bridges", views="spiral", sql=f"""
WITH RECURSIVE {_OFFSETS}, q AS (SELECT *, x + off * nx AS cx, y + off * ny AS cy FROM p), st(dr, dc) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1)),
e AS (SELECT a.id AS a, b.id AS b FROM q a, st JOIN q b ON b.sheet = a.sheet AND b.r = a.r + dr AND b.c = a.c + dc WHERE abs((a.cx - b.cx) * (a.nx + b.nx) + (a.cy - b.cy) * (a.ny + b.ny)) <= CAST(7.4 AS DOUBLE) * sqrt((a.nx + b.nx) ** 2 + (a.ny + b.ny) ** 2)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT id, id FROM q), it(i, id, l) AS (SELECT 0, id, id FROM q UNION ALL SELECT any_value(it.i) + 1, e2.a, min(it.l) FROM it JOIN e2 ON e2.b = it.id WHERE it.i < 250 GROUP BY e2.a)
SELECT l AS component, count(*) FILTER (off < 2) AS on_a, count(*) FILTER (off >= 8) AS on_b FROM it JOIN q USING (id) WHERE it.i = 250 GROUP BY 1 HAVING count(*) FILTER (off < 2) >= 5 AND count(*) FILTER (off >= 8) >= 5""")
def g12_bridges(t):
    p = _points(t)
    named = sheets.linked_components(p, 7.4).join(p.select("id", "off"), "id")
    return sheets.bridges(named.select("component", F.when(F.col("off") < 2, 0).otherwise(1).alias("weight"), F.lit(8.0).alias("apart")), 6.0, 5)


# pieces of 512 a slice; labels rise every 7 pieces, those of every 53rd customer are wrong, some are missing
_PIECES = """pc AS (SELECT o_orderkey AS piece, o_orderkey // 512 AS slice, o_orderkey % 512 // 128 AS component, CASE WHEN o_custkey % 97 <> 0 THEN o_orderkey % 512 // 7 + CASE WHEN o_custkey % 53 = 0 THEN 1 ELSE 0 END END AS label FROM orders),
ed AS (SELECT piece AS a, piece + d AS b, (piece + d) % 512 // 7 - piece % 512 // 7 AS step FROM pc, (VALUES (1), (9)) v(d) WHERE (piece + d) // 512 = slice AND piece + d IN (SELECT piece FROM pc)),
ew AS (SELECT a, b, coalesce(y.label - x.label <> step, true) AS wrong FROM ed JOIN pc x ON x.piece = a JOIN pc y ON y.piece = b), l2 AS (SELECT a, b FROM ew UNION ALL SELECT b, a FROM ew),
d0 AS (SELECT a AS piece FROM ew WHERE wrong UNION SELECT b FROM ew WHERE wrong), d1 AS (SELECT DISTINCT b AS piece FROM l2 JOIN d0 ON a = piece WHERE b NOT IN (SELECT piece FROM d0)), d2 AS (SELECT DISTINCT b AS piece FROM l2 JOIN d1 ON a = piece WHERE b NOT IN (SELECT piece FROM d0) AND b NOT IN (SELECT piece FROM d1)),
ds AS (SELECT piece, 0 AS distance FROM d0 UNION ALL SELECT piece, 1 FROM d1 UNION ALL SELECT piece, 2 FROM d2), su AS (SELECT pc.*, coalesce(distance = 0, false) AS bad, distance, distance IS NULL AND label IS NOT NULL AS sure FROM pc LEFT JOIN ds USING (piece)),
mc AS (SELECT slice, max({'n': n, 'k': -component}).k * -1 AS m FROM (SELECT slice, component, count(*) AS n FROM su WHERE sure GROUP BY 1, 2) GROUP BY 1), mp AS (SELECT su.*, coalesce(sure AND component = m, false) AS main FROM su LEFT JOIN mc USING (slice))"""


def _sure(t):
    o = F.col("o_orderkey")
    within = o % 512
    label = F.when(F.col("o_custkey") % 97 != 0, F.floor(within / 7) + F.when(F.col("o_custkey") % 53 == 0, 1).otherwise(0))
    pieces = t.orders.select(o.alias("piece"), F.floor(o / 512).alias("slice"), F.floor(within / 128).alias("component"), label.alias("label"))
    a = pieces.select(F.col("piece").alias("a"), "slice").withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 9))).where(F.floor(F.col("b") / 512) == F.col("slice"))
    return sheets.sure_pieces(pieces, a.select("a", "b", (F.floor(F.col("b") % 512 / 7) - F.floor(F.col("a") % 512 / 7)).alias("step")))


@query("e11_sure_pieces", sql=f"WITH {_PIECES} SELECT piece, slice, component, label, bad, distance, sure, main FROM mp")
def e11(t):
    return _sure(t).select("piece", "slice", "component", "label", "bad", "distance", "sure", "main")


_LADDER = f"""{_PIECES}, ma AS (SELECT *, label - min(label) OVER (PARTITION BY slice) AS wind, dense_rank() OVER (PARTITION BY slice ORDER BY label) - 1 AS level FROM mp WHERE main),
px AS (SELECT slice, piece, l_partkey % 1000 * CAST(0.006 AS DOUBLE) AS theta, l_quantity AS radius, wind, level FROM lineitem JOIN ma ON piece = l_orderkey), nu AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY theta, radius) - 1 AS i, count(*) OVER (PARTITION BY piece) AS n FROM px),
pt AS (SELECT * FROM nu WHERE n <= 4 OR list_contains(list_transform(range(4), lambda j: round_even(j * (n - 1) / CAST(3 AS DOUBLE), 0)::BIGINT), i))"""


def _ladder(t):
    pieces = _sure(t)
    pixels = t.lineitem.select(F.col("l_orderkey").alias("piece"), (F.col("l_partkey") % 1000 * 0.006).alias("theta"), F.col("l_quantity").alias("radius"))
    return pieces, sheets.ladder_points(pixels, pieces, 4)


@query("e11_ladder_points", sql=f"WITH {_LADDER} SELECT slice, piece, round(theta, 6) AS theta, radius, wind, level, wind + level AS wind_plus_one FROM pt")
def e11_points(t):
    return _ladder(t)[1].withColumn("theta", F.round("theta", 6))


@query("e11_ladder_report", sql=f"""
WITH {_LADDER}, a AS (SELECT slice, count(*) AS pieces, count(*) FILTER (bad) AS bad, count(*) FILTER (sure) AS sure, count(*) FILTER (main) AS written, count(DISTINCT CASE WHEN sure THEN component END) AS components FROM mp GROUP BY 1),
b AS (SELECT slice, count(*) AS points, count(DISTINCT wind) AS levels, max(wind) - min(wind) AS span, max(gap) AS max_gap FROM (SELECT *, theta - lag(theta) OVER (PARTITION BY slice ORDER BY theta) AS gap FROM pt) GROUP BY 1)
SELECT slice, pieces, bad, sure, written, sure - written AS left_out, components, coalesce(points, 0) AS points, coalesce(levels, 0) AS levels, span, round(coalesce(max_gap, 0), 6) AS max_gap FROM a LEFT JOIN b USING (slice)""")
def e11_report(t):
    return sheets.ladder_report(*_ladder(t)).withColumn("max_gap", F.round("max_gap", 6))


@query("j3_nearest_any", sql="""
WITH a AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey * CAST(400 AS DOUBLE) AS y FROM customer), b AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * CAST(400 AS DOUBLE) AS y FROM supplier),
p AS (SELECT k, id, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) AS d2 FROM a, b), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d2, id) AS place FROM p) SELECT k, place::INT AS place, id, round(sqrt(d2), 6) AS distance FROM r WHERE place <= 3""")
def j3_any(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 400.0).alias("y"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 400.0).alias("y"))
    return spatial.k_nearest(a, b, ["x", "y"], ["k"], ["id"], 60.0, 3)
