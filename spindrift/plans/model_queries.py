"""Queries of the graph, language-model and vector operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..operators import graph as g
from ..operators import heads as hd
from ..operators import ngrams as ng
from ..operators import vectors as vc
from ..operators.stats import r6
from .registry import query


@query("g1_components", views="px", sql="""
WITH RECURSIVE n AS (SELECT y * 64 + x AS id, y, x FROM px WHERE map_id = 0 AND v >= 170), e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON abs(a.y - b.y) + abs(a.x - b.x) = 1),
w(id, root) AS (SELECT id, id FROM n UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id AND w.root < e.b)
SELECT component, count(*) AS n FROM (SELECT id, min(root) AS component FROM w GROUP BY 1) GROUP BY 1""")
def g1(t):
    n = t.px.where("map_id = 0 and v >= 170").select((F.col("y") * 64 + F.col("x")).alias("node"), "y", "x")
    right = n.select(F.col("node").alias("a"), "y", (F.col("x") + 1).alias("x")).unionByName(n.select(F.col("node").alias("a"), (F.col("y") + 1).alias("y"), "x"))
    edges = right.join(n, ["y", "x"]).select("a", F.col("node").alias("b"))
    return g.components(n.select("node"), edges).groupBy("component").agg(F.count("*").alias("n"))


@query("g2_interior_holes", views="px", sql="""
WITH RECURSIVE h AS (SELECT y, x, y * 64 + x AS id FROM px WHERE map_id = 1 AND v < 60), e AS (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON abs(a.y - b.y) + abs(a.x - b.x) = 1), w(id, root) AS (SELECT id, id FROM h UNION SELECT e.b, w.root FROM w JOIN e ON e.a = w.id AND w.root < e.b),
c AS (SELECT id, min(root) AS comp FROM w GROUP BY 1), o AS (SELECT DISTINCT comp FROM c JOIN h USING (id) WHERE y % 64 IN (0, 63) OR x IN (0, 63)) SELECT comp AS component, count(*) AS n FROM c WHERE comp NOT IN (SELECT comp FROM o) GROUP BY 1""")
def g2(t):
    h = t.px.where("map_id = 1 and v < 60").select((F.col("y") * 64 + F.col("x")).alias("node"), "y", "x")
    step = h.select(F.col("node").alias("a"), "y", (F.col("x") + 1).alias("x")).unionByName(h.select(F.col("node").alias("a"), (F.col("y") + 1).alias("y"), "x"))
    c = g.components(h.select("node"), step.join(h, ["y", "x"]).select("a", F.col("node").alias("b"))).join(h, "node")
    border = c.where("y % 64 in (0, 63) or x in (0, 63)").select("component").distinct()
    return c.join(border, "component", "left_anti").groupBy("component").agg(F.count("*").alias("n"))


@query("g4_consistency", views="steps", sql="""
WITH RECURSIVE e AS (SELECT DISTINCT a, b, k FROM steps WHERE a <> b), conf AS (SELECT count(*) AS n FROM (SELECT a, b FROM e GROUP BY 1, 2 HAVING count(*) > 1)), m AS (SELECT a, b, min(k) AS k FROM e GROUP BY 1, 2),
f AS (SELECT a, b FROM m UNION SELECT b, a FROM m), nodes AS (SELECT DISTINCT a AS id FROM f), gap AS (SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.a < nodes.id AND m.b >= nodes.id) THEN 1 ELSE 0 END AS fresh FROM nodes), c AS (SELECT id, sum(fresh) OVER (ORDER BY id) AS comp FROM gap)
SELECT count(DISTINCT comp) AS components, (SELECT count(DISTINCT comp) FROM e JOIN c ON c.id = e.a WHERE e.k <> floor(e.b / CAST(7 AS DOUBLE)) - floor(e.a / CAST(7 AS DOUBLE))) AS inconsistent, 0::BIGINT AS self_loops, (SELECT n FROM conf) AS conflicting_pairs FROM c""")
def g4(t):
    return g.consistency(t.steps)


@query("g6_closure", sql="""
WITH RECURSIVE l AS (SELECT s_suppkey AS child, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 0), w AS (SELECT child, parent AS ancestor, 1 AS depth FROM l UNION ALL SELECT w.child, l.parent, depth + 1 FROM w JOIN l ON l.child = w.ancestor) SELECT child, ancestor, min(depth)::INT AS depth FROM w GROUP BY 1, 2""")
def g6(t):
    return g.closure(t.supplier.where("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.floor(F.col("s_suppkey") / 2).alias("parent")))


@query("g8_line_fit", sql="SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def g8(t):
    return g.line_fit(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("g9_drift_fit", sql="""
WITH f AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1), r AS (SELECT l.*, l_extendedprice - i - s * l_quantity AS res FROM lineitem l JOIN f USING (l_suppkey)),
m AS (SELECT l_suppkey, median(res) AS mid FROM r GROUP BY 1), d AS (SELECT r.*, abs(res - mid) AS dev FROM r JOIN m USING (l_suppkey)), k AS (SELECT l_suppkey, greatest(1, 3 * median(dev)) AS lim FROM d GROUP BY 1)
SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM d JOIN k USING (l_suppkey) WHERE dev <= lim GROUP BY 1""")
def g9(t):
    return g.drift_fit(t.lineitem, ["l_suppkey"], "l_quantity", "l_extendedprice").select("l_suppkey", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.col("n").cast("long").alias("n"))


@query("g11_topology", sql="""
WITH t AS (SELECT l_orderkey % 500 AS a, l_partkey % 500 AS b, l_suppkey % 500 AS c FROM lineitem), d AS (SELECT a AS u, b AS v FROM t WHERE a <> b AND b <> c AND a <> c UNION ALL SELECT b, c FROM t WHERE a <> b AND b <> c AND a <> c UNION ALL SELECT c, a FROM t WHERE a <> b AND b <> c AND a <> c),
n AS (SELECT u, v, count(*) AS n FROM d GROUP BY 1, 2), e AS (SELECT least(u, v) AS u, greatest(u, v) AS v, sum(n) AS n, max(n) AS most FROM n GROUP BY 1, 2)
SELECT (SELECT count(*) FROM t) AS triangles, (SELECT count(*) FROM t WHERE a = b OR b = c OR a = c) AS degenerate, count(*) AS edges, count(*) FILTER (n >= 3) AS crowded, count(*) FILTER (most >= 2) AS repeated FROM e""")
def g11(t):
    return g.mesh_topology(t.lineitem.select((F.col("l_orderkey") % 500).alias("a"), (F.col("l_partkey") % 500).alias("b"), (F.col("l_suppkey") % 500).alias("c")))


_LET = "d AS (SELECT doc_id, trim(regexp_replace(upper(translate(text, 'ßàáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'saaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^A-Z]+', ' ', 'g')) AS t FROM documents)"
_G3 = f"{_LET}, g AS (SELECT doc_id, substr('^^' || t, i, 3) AS gram FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM d WHERE length(t) > 0)), c3 AS (SELECT gram, count(*) AS n FROM g GROUP BY 1)"


def _kn(k: int) -> str:
    return f""", q{k} AS (SELECT count(*) FILTER (n = 1)::DOUBLE AS n1, count(*) FILTER (n = 2)::DOUBLE AS n2, count(*) FILTER (n = 3)::DOUBLE AS n3, count(*) FILTER (n = 4)::DOUBLE AS n4 FROM c{k}),
 e{k} AS (SELECT greatest(0, 1 - 2 * y * n2 / greatest(1, n1)) AS d1, greatest(0, 2 - 3 * y * n3 / greatest(1, n2)) AS d2, greatest(0, 3 - 4 * y * n4 / greatest(1, n3)) AS d3 FROM (SELECT *, n1 / greatest(1, n1 + 2 * n2) AS y FROM q{k})),
 u{k} AS (SELECT gram, substr(gram, 1, {k - 1}) AS ctx, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS cut FROM c{k}, e{k}),
 x{k} AS (SELECT ctx, sum(n)::DOUBLE AS total, sum(cut) / sum(n) AS back FROM u{k} GROUP BY 1), p{k} AS (SELECT gram, (n - cut) / total AS p FROM u{k} JOIN x{k} USING (ctx))"""


def _letters(t):
    return t.documents.select("doc_id", tx.letters_only(F.col("text")).alias("t"))


@query("l1_ngram_counts", sql=f"WITH {_G3} SELECT gram, n FROM c3 WHERE n >= 2")
def l1(t):
    return ng.ngram_counts(_letters(t), "t", 3, 2)


@query("l2_continuations", sql=f"WITH {_G3} SELECT substr(gram, 2) AS gram, count(*) AS n FROM c3 GROUP BY 1")
def l2(t):
    return ng.continuations(ng.ngram_counts(_letters(t), "t", 3))


@query("l3_kn_tables", sql=f"WITH {_G3}{_kn(3)} SELECT gram, round(p, 9) AS p, round(back, 9) AS back FROM p3 JOIN x3 ON x3.ctx = substr(gram, 1, 2)")
def l3(t):
    return ng.kn_table(ng.ngram_counts(_letters(t), "t", 3)).select("gram", F.round("p", 9).alias("p"), F.round("back", 9).alias("back"))


@query("l4_kn_score")
def l4(t):
    docs = _letters(t)
    model = ng.kn_model(docs, "t", 3)
    s = ng.kn_score(docs, "doc_id", "t", model, 27, model[-1])
    return s.select("doc_id", "letters", F.round(F.col("bits") / F.col("letters"), 4).alias("bits_per_letter"))


@query("l5_em_weights", views="px", sql="""
WITH RECURSIVE p AS (SELECT a.v / CAST(255 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS p, b.v / CAST(255 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS q FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.map_id = 0 AND b.map_id = 1),
it(i, w) AS (SELECT 0, CAST(0.5 AS DOUBLE) UNION ALL SELECT i + 1, (SELECT avg(it.w * p / (it.w * p + (1 - it.w) * q)) FROM p) FROM it WHERE i < 20)
SELECT 'p' AS model, round(w, 5) AS weight FROM it WHERE i = 20 UNION ALL SELECT 'q', round(1 - w, 5) FROM it WHERE i = 20""")
def l5(t):
    a = t.px.where("map_id = 0").select("y", "x", (F.col("v") / 255.0 + 0.01).alias("p"))
    probs = a.join(t.px.where("map_id = 1").select("y", "x", (F.col("v") / 255.0 + 0.01).alias("q")), ["y", "x"]).select("p", "q")
    w = ng.em_weights(g.written(probs, "probs"), ["p", "q"])
    return t.spark.createDataFrame([(k, round(v, 5)) for k, v in w.items()], "model string, weight double")


@query("v1_normalize", sql="SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def v1(t):
    return t.embeddings.select("vec_id", "label", F.round(F.sqrt(vc.dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("v2_similar", sql="""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM u), p AS (SELECT q.vec_id AS query, n.vec_id, round(list_dot_product(q.e, n.e) / q.l / n.l, 6) AS cosine FROM n q JOIN n ON n.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM p) SELECT query, vec_id, cosine, place FROM r WHERE place <= 10""")
def v2(t):
    return vc.similar(t.embeddings, "vec_id", "embedding", 10)


@query("v3_anchor_score", sql="""
WITH f AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS a FROM f GROUP BY 1), u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT vec_id, label, round(list_dot_product(e, a) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(a, a)), 9) AS c FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS rn FROM s)
SELECT vec_id, label AS anchor, round(greatest(0, least(1, (c - CAST(0.2 AS DOUBLE)) / CAST(0.6 AS DOUBLE))), 5) AS score FROM r WHERE rn = 1""")
def v3(t):
    anchors = vc.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "anchor")
    out = vc.anchor_score(t.embeddings, "vec_id", "embedding", anchors, 0.2, 0.8)
    return out.select("vec_id", "anchor", F.round("score", 5).alias("score"))


@query("v5_main_direction")
def v5(t):
    out = vc.main_direction(t.embeddings, "vec_id", "embedding")
    low, high = F.percentile("along", F.lit(0.01)), F.percentile("along", F.lit(0.99))
    return out.join(F.broadcast(out.agg(low.alias("lo"), high.alias("hi")))).select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("along") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)), 2).alias("level"))  # one row


@query("v6_platt", views="scored_docs")
def v6(t):
    docs = g.written(t.scored_docs.select((F.log1p("score") / 10).alias("z"), "label"), "platt")
    a, b = vc.platt_fit(docs, "z", "label")
    return t.scored_docs.groupBy("lang").agg(r6(F.avg(1 / (1 + F.exp(-(a * F.log1p("score") / 10 + b))))).alias("mean_p"), F.count("*").alias("n"))


@query("v7_with_prior", sql="""
WITH c AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS prior, count(*) OVER ()::DOUBLE AS k FROM embeddings GROUP BY 1) SELECT vec_id, round(ln(abs(embedding[1]::DOUBLE) + 0.01) - ln(prior) + ln(1 / k), 5) AS adjusted FROM embeddings JOIN c USING (label)""")
def v7(t):
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    totals = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    prior = n.join(F.broadcast(totals)).select("label", (F.col("n") / F.col("total")).alias("prior"), "k")  # one row of totals
    e = t.embeddings.join(prior, "label")
    return e.select("vec_id", F.round(F.log(F.abs(F.col("embedding")[0].cast("double")) + 0.01) - F.log("prior") + F.log(1 / F.col("k")), 5).alias("adjusted"))


@query("t12_derange", sql="""
WITH h AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5(s_suppkey || '|5'), s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT a.s_suppkey, b.s_suppkey AS paired FROM h a JOIN h b ON a.s_nationkey = b.s_nationkey AND b.i = a.i % a.n + 1""")
def t12(t):
    w = W.partitionBy("s_nationkey").orderBy(F.md5(F.concat_ws("|", F.col("s_suppkey").cast("string"), F.lit("5"))), "s_suppkey")
    first = F.first("s_suppkey").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return t.supplier.select("s_suppkey", F.coalesce(F.lead("s_suppkey").over(w), first).alias("paired"))


def _rated(t):
    """Vectors beside what is known of the document of the same number; ten points a label."""
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return t.embeddings.join(docs, F.col("vec_id") == F.col("doc_id"), "left").withColumn("rating", F.col("label") * 10.0).withColumn("size", F.log1p("n_chars"))


@query("v4_nested_report")
def v4_nested(t):
    rated = _rated(t)
    kinds = hd.levels(rated, ["lang", "source"])
    out = None
    for name, vector in (("full", "embedding"), ("meta", None)):
        scored = hd.nested_scores(rated, "vec_id", "rating", hd.features(vector, ["size"], kinds), reps=3)
        part = hd.band_report(scored, 70).select(F.lit(name).alias("head"), *[F.round(c, 6).alias(c) for c in ("spearman", "spearman_sd", "high_precision", "high_recall", "high_items", "rated_high")])
        out = part if out is None else out.unionByName(part)
    return out


@query("v4_fitted_head")
def v4_fitted(t):
    rated = _rated(t)
    x = hd.features("embedding", ["size"], hd.levels(rated, ["lang", "source"]))
    head = hd.fit_head(rated, "vec_id", "rating", x, how="isotonic")
    return rated.select("vec_id", F.round(head.apply(x), 4).alias("score"))
