"""Queries of local alignments beside decoys, and of gaps that a letter model fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ngrams as ng
from ..operators import paired, reading
from ..operators.stats import r6
from .model_queries import _kn
from .more_queries import _FOLD
from .registry import query
from .stats_queries import _draw, _pair

_ALIGNED = f"""q0 AS (SELECT item_id, string_split({_FOLD}, ' ') AS w FROM benchmark), d AS (SELECT doc_id, string_split({_FOLD}, ' ') AS w FROM documents),
q1 AS (SELECT item_id, unnest(range(10)) AS draw, w FROM q0), q2 AS (SELECT item_id, draw, unnest(range(1, len(w) + 1)) AS i, w FROM q1),
q AS (SELECT item_id, draw, CASE WHEN draw = 0 THEN i ELSE row_number() OVER (PARTITION BY item_id, draw ORDER BY {_draw("(item_id % 1000003 * 4096 + i - 1)", "draw", 11)}, i) END AS i, w[i] AS w FROM q2),
qg AS (SELECT item_id, draw, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM q WINDOW o AS (PARTITION BY item_id, draw ORDER BY i)), dg AS (SELECT doc_id, array_to_string(w[j:j + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS j FROM d WHERE len(w) >= 3)),
pr AS (SELECT DISTINCT item_id, draw, doc_id FROM qg JOIN dg USING (g) WHERE g IS NOT NULL), t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS w FROM d WHERE doc_id IN (SELECT doc_id FROM pr)),
it(item_id, draw, doc_id, i, j, h) AS (SELECT item_id, draw, doc_id, 0::BIGINT, j, 0::BIGINT FROM pr JOIN t USING (doc_id) UNION ALL
 SELECT item_id, draw, doc_id, i, j, (max(hp + 2 * j) OVER (PARTITION BY item_id, draw, doc_id ORDER BY j) - 2 * j)::BIGINT FROM (SELECT it.item_id, it.draw, it.doc_id, it.i + 1 AS i, it.j, greatest(0, it.h - 2, coalesce(lag(it.h) OVER (PARTITION BY it.item_id, it.draw, it.doc_id ORDER BY it.j), 0) + CASE WHEN q.w = t.w THEN 1 ELSE -2 END) AS hp
 FROM it JOIN q ON q.item_id = it.item_id AND q.draw = it.draw AND q.i = it.i + 1 JOIN t ON t.doc_id = it.doc_id AND t.j = it.j)),
sc AS (SELECT item_id, draw, doc_id, max(h) AS score FROM it GROUP BY 1, 2, 3 HAVING max(h) >= 3)"""


def _reads(t):
    fold = lambda df, key: df.select(key, F.split(tx.letters_only(F.col("text")), " ").alias("w"))
    return reading.decoys(fold(t.benchmark, "item_id"), "item_id", 9, 11), fold(t.documents, "doc_id")


@query("x11_local_alignments", sql=f"WITH RECURSIVE {_ALIGNED} SELECT item_id, draw, doc_id, score FROM sc")
def x11_local(t):
    return reading.local_alignments(*_reads(t), "item_id", "doc_id").select("item_id", "draw", "doc_id", "score")


@query("x11_decoys", sql=f"""
WITH RECURSIVE {_ALIGNED}, b AS (SELECT item_id, draw, max(score) AS top FROM sc GROUP BY 1, 2), re AS (SELECT item_id, coalesce(max(top), 0) AS score FROM q0 LEFT JOIN b USING (item_id) WHERE coalesce(draw, 0) = 0 GROUP BY 1 UNION ALL SELECT item_id, 0 FROM q0 WHERE item_id IN (SELECT item_id FROM b) AND item_id NOT IN (SELECT item_id FROM b WHERE draw = 0)),
ti AS (SELECT item_id, min(doc_id) AS doc_id, count(*) AS ties FROM sc JOIN re USING (item_id, score) WHERE draw = 0 GROUP BY 1), dc AS (SELECT re.item_id, sum(top) AS total, max(top) AS most, count(*) FILTER (top >= score) AS over FROM re JOIN b ON b.item_id = re.item_id AND draw > 0 GROUP BY 1)
SELECT item_id, score::INT AS score, doc_id, coalesce(ties, 0) = 1 AS "only", round(coalesce(total, 0) / CAST(9 AS DOUBLE), 6) AS decoy_mean, coalesce(most, 0)::INT AS decoy_max, round(score - coalesce(total, 0) / CAST(9 AS DOUBLE), 6) AS excess, round((CASE WHEN score = 0 THEN 9 ELSE coalesce(over, 0) END + 1) / CAST(10 AS DOUBLE), 6) AS p
FROM re LEFT JOIN ti USING (item_id) LEFT JOIN dc USING (item_id)""")
def x11_decoys(t):
    reads, texts = _reads(t)
    found = reading.decoy_scores(reading.written(reading.local_alignments(reads, texts, "item_id", "doc_id"), "aligned"), reads, "item_id", "doc_id", 9)
    return found.select("item_id", "score", "doc_id", "only", r6("decoy_mean").alias("decoy_mean"), "decoy_max", r6("excess").alias("excess"), r6("p").alias("p"))


_ALPHABET = " ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LENGTHS = [1, 2, 3, 5]
_KEY = "(doc_id % 1000003)"
# the model reads four fifths of the documents, the gaps are in the others
_GAPS = f"""ld AS (SELECT doc_id, {_FOLD} AS t FROM documents), g AS (SELECT substr('^^' || t, i, 3) AS gram FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM ld WHERE doc_id % 5 <> 0 AND length(t) > 0)),
c3 AS (SELECT gram, count(*) AS n FROM g GROUP BY 1), c2 AS (SELECT substr(gram, 2) AS gram, count(*) AS n FROM c3 GROUP BY 1), c1 AS (SELECT substr(gram, 2) AS gram, count(*) AS n FROM c2 GROUP BY 1){_kn(3)}{_kn(2)}{_kn(1)},
al AS (SELECT unnest(string_split('{_ALPHABET}', '')) AS l), ax AS (SELECT l FROM al UNION ALL SELECT '^'), ag AS (SELECT a.l || b.l || c.l AS gram FROM ax a, ax b, al c),
lp AS (SELECT ag.gram, log2(coalesce(p3.p, 0) + coalesce(x3.back, 1) * (coalesce(p2.p, 0) + coalesce(x2.back, 1) * (coalesce(p1.p, 0) + coalesce(x1.back, 1) / CAST(27 AS DOUBLE)))) AS logp FROM ag LEFT JOIN p3 ON p3.gram = ag.gram LEFT JOIN x3 ON x3.ctx = substr(ag.gram, 1, 2) LEFT JOIN p2 ON p2.gram = substr(ag.gram, 2) LEFT JOIN x2 ON x2.ctx = substr(ag.gram, 2, 1) LEFT JOIN p1 ON p1.gram = substr(ag.gram, 3) LEFT JOIN x1 ON x1.ctx = ''),
i0 AS (SELECT doc_id, t, length(t) AS n, [1, 2, 3, 5][({_draw(_KEY, "0", 5)} % 4 + 1)::INT] AS length FROM ld WHERE doc_id % 5 = 0), i1 AS (SELECT *, (60 + {_draw(_KEY, "1", 5)} % (n - 84 - length + 1))::BIGINT AS a FROM i0 WHERE n - 84 - length >= 0),
im AS (SELECT doc_id, length, substr(t, a - 59, 60) AS "left", substr(t, a + length + 1, 24) AS "right", substr(t, a + 1, length) AS truth FROM i1)"""


def _filled(name: str, beam: int) -> str:
    return f""", {name}(doc_id, i, length, bef, rig, fill, score) AS (SELECT doc_id, 0, length, '^^' || "left", "right", '', CAST(0 AS DOUBLE) FROM im UNION ALL
 SELECT doc_id, i, length, bef, rig, fill, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, fill) AS k FROM (SELECT b.doc_id, b.i + 1 AS i, b.length, b.bef, b.rig, b.fill || al.l AS fill, round(b.score + lp.logp, 9) AS score FROM {name} b, al JOIN lp ON lp.gram = right(b.bef || b.fill, 2) || al.l WHERE b.i < b.length)) WHERE k <= {beam}),
{name}t AS (SELECT doc_id, fill, sum(lp.logp) AS after FROM (SELECT *, unnest(range(1, least(length(rig), 2) + 1)) AS z FROM {name} WHERE i = length AND length(rig) > 0) e JOIN lp ON lp.gram = right(right(bef || fill, 2) || substr(rig, 1, z), 3) GROUP BY 1, 2),
{name}f AS (SELECT doc_id, max(length) AS length, min({{'s': -round(score + coalesce(after, 0), 9), 'fill': fill}}) AS m FROM {name} LEFT JOIN {name}t USING (doc_id, fill) WHERE i = length GROUP BY 1)"""


def _gaps(t):
    docs = t.documents.select("doc_id", tx.letters_only(F.col("text")).alias("t"))
    return reading.written(reading.make_gaps(docs.where("doc_id % 5 = 0"), "doc_id", "t", _LENGTHS, 60, 24, 5), "gaps"), ng.kn_model(docs.where("doc_id % 5 <> 0"), "t", 3)


@query("l6_fill_gaps", sql=f"""WITH RECURSIVE {_GAPS}{_filled("bm", 16)} SELECT doc_id, im.length, truth, bmf.m.fill AS fill, round(-bmf.m.s, 5) AS score FROM im JOIN bmf USING (doc_id)""")
def l6(t):
    items, model = _gaps(t)
    fills = reading.fill_gaps(items, "doc_id", model, _ALPHABET, 16)
    return items.select("doc_id", "length", "truth").join(fills, "doc_id").select("doc_id", F.col("length").cast("long").alias("length"), "truth", "fill", F.round("score", 5).alias("score"))


_HITS = "len(list_filter(range(1, im.length + 1), lambda z: substr(truth, z, 1) = substr({f}, z, 1)))"


@query("l6_fill_report", sql=f"""
WITH RECURSIVE {_GAPS}{_filled("bm", 16)}{_filled("gr", 1)}, h0 AS (SELECT doc_id % 64 AS unit, im.length, length(truth) AS letters, {_HITS.format(f="bmf.m.fill")} AS a, {_HITS.format(f="grf.m.fill")} AS b, (truth = bmf.m.fill)::INT AS exact FROM im JOIN bmf USING (doc_id) JOIN grf USING (doc_id)),
h AS (SELECT unnest([length, 0]) AS length, unit, letters, a, b, exact FROM h0), u AS (SELECT length, unit, sum(letters) AS letters, sum(a) AS a, sum(b) AS b, sum(exact) AS exact, count(*) AS items FROM h GROUP BY 1, 2),
w AS (SELECT d, {_draw("s", "d", 13)} % 64 AS unit, count(*) AS weight FROM (SELECT unnest(range(0, 64)) AS s), (SELECT unnest(range(0, 200)) AS d) GROUP BY 1, 2), r AS (SELECT length, d, sum((a - b) * weight)::DOUBLE / sum(letters * weight) AS diff FROM u JOIN w USING (unit) GROUP BY 1, 2),
iv AS (SELECT length, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high FROM r GROUP BY 1)
SELECT length::BIGINT AS length, sum(items)::BIGINT AS items, sum(letters)::BIGINT AS letters, round(sum(a) / sum(letters)::DOUBLE, 6) AS accuracy, round(sum(exact) / sum(items)::DOUBLE, 6) AS exact, round(sum(b) / sum(letters)::DOUBLE, 6) AS other_accuracy, round((sum(a) - sum(b)) / sum(letters)::DOUBLE, 6) AS diff, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM u LEFT JOIN iv USING (length) GROUP BY 1""")
def l6_report(t):
    items, model = _gaps(t)
    fills = [reading.fill_gaps(items, "doc_id", model, _ALPHABET, beam) for beam in (16, 1)]
    found = reading.score_fills(items, *fills, "doc_id", 200, 64, 13)
    return found.select(F.col("length").cast("long").alias("length"), "items", "letters", *[r6(c).alias(c) for c in ("accuracy", "exact", "other_accuracy", "diff", "low", "high")])


_DIFF = """pq AS (SELECT a.y, a.x, a.v AS p, b.v AS q, CASE WHEN (a.y + a.x) % 3 = 0 THEN a.v ELSE b.v END AS w, (a.y // 16 % 4) * 4 + a.x // 16 AS unit FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.map_id = 0 AND b.map_id = 1)"""


def _drawn(diff: str, seed: int, draws: int) -> str:
    """Share and median of each draw of clusters; a difference stands as often as its cluster is drawn."""
    return f"""lv AS (SELECT unit, {diff} AS d FROM pq), wt AS (SELECT d AS draw, {_draw("s", "d", seed)} % 16 AS unit, count(*) AS weight FROM (SELECT unnest(range(0, 16)) AS s), (SELECT unnest(range(0, {draws})) AS d) GROUP BY 1, 2)"""


_READOUT = """dr AS (SELECT draw, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS share, median(d) AS median FROM (SELECT draw, d, unnest(range(weight)) FROM lv JOIN wt USING (unit)) GROUP BY 1),
o AS (SELECT count(*) AS n, count(DISTINCT unit) AS clusters, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS share, median(d) AS median FROM lv), e AS (SELECT quantile_cont(share, 0.025) AS share_low, quantile_cont(share, 0.975) AS share_high, quantile_cont(median, 0.025) AS median_low, quantile_cont(median, 0.975) AS median_high FROM dr)
SELECT n, clusters, round(share, 6) AS share, median, round(share_low, 6) AS share_low, round(share_high, 6) AS share_high, round(median_low, 6) AS median_low, round(median_high, 6) AS median_high, share_low > 0.5 AND median_low > 0 AS passes FROM o, e"""


def _units(t):
    unit = F.floor(F.col("y") / 16) % 4 * 4 + F.floor(F.col("x") / 16)
    return _pair(t).withColumns({"unit": unit, "w": F.when((F.col("y") + F.col("x")) % 3 == 0, F.col("p")).otherwise(F.col("q"))})


def _rounded(df):
    return df.select(*[r6(c).alias(c) if c.startswith(("share", "median_")) else c for c in df.columns])


@query("a36_readout", views="px", sql=f"WITH {_DIFF}, {_drawn('p - q + 9', 17, 60)}, {_READOUT}")
def a36_readout(t):
    return _rounded(paired.paired_readout(_units(t), F.col("p") - F.col("q") + 9, "unit", 16, 60, 17))


# processing control: the side damaged at two of three places against the other
@query("a36_processing", views="px", sql=f"WITH {_DIFF}, {_drawn('w - q', 19, 60)}, {_READOUT}")
def a36_processing(t):
    return _rounded(paired.paired_readout(_units(t), F.col("w") - F.col("q"), "unit", 16, 60, 19))


@query("a36_degradation", views="px", sql=f"WITH {_DIFF} SELECT median(p - q + 9) AS median, median(w - q) AS median_lead, CASE WHEN median(p - q + 9) > 0 THEN median(w - q) <= median(p - q + 9) / 2 END AS holds FROM pq")
def a36_degradation(t):
    return paired.degradation(_units(t), F.col("p") - F.col("q") + 9, F.col("w") - F.col("q"))


@query("a36_sign_flips", views="px", sql=f"""
WITH {_DIFF}, {_drawn('p - q + 9', 24, 40)}, fl AS (SELECT f, unit, CASE WHEN {_draw("unit", "f", 23)} % 2 = 0 THEN d ELSE -d END AS d FROM lv, (SELECT unnest(range(0, 20)) AS f)),
dr AS (SELECT f, draw, avg(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS share, median(d) AS median FROM (SELECT f, draw, d, unnest(range(weight)) FROM fl JOIN wt USING (unit)) GROUP BY 1, 2), lo AS (SELECT f, quantile_cont(share, 0.025) AS share, quantile_cont(median, 0.025) AS median FROM dr GROUP BY 1)
SELECT 20 AS flips, count(*) FILTER (share > 0.5 AND median > 0) AS passes, count(*) FILTER (share > 0.5 AND median > 0) / CAST(20 AS DOUBLE) AS share, count(*) FILTER (share > 0.5 AND median > 0) / CAST(20 AS DOUBLE) <= 0.05 AS holds FROM lo""")
def a36_sign_flips(t):
    return paired.sign_flips(_units(t), F.col("p") - F.col("q") + 9, "unit", 16, seed=23)


@query("a36_border", views="px", sql=f"WITH {_DIFF} SELECT count(*) AS n, count(*) FILTER (p % 16 IN (0, 15)) AS at_border, round(count(*) FILTER (p % 16 IN (0, 15)) / count(*)::DOUBLE, 6) AS share, count(*) FILTER (p % 16 IN (0, 15)) / count(*)::DOUBLE <= 0.1 AS holds FROM pq")
def a36_border(t):
    return _rounded(paired.border_share(_units(t), (F.col("p") % 16).isin(0, 15)))
