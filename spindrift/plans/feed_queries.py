"""Queries of the feed, text and catalog operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx
from ..operators import feed as fd
from ..operators import grids as gr
from ..operators import setops as so
from ..operators.stats import r6
from .registry import query


@query("p1_feed_filter", views="feed", sql="""SELECT id, source, kind, score FROM feed WHERE ts >= TIMESTAMP '2024-01-10' AND source IN ('click', 'view') AND kind IN ('en', 'fr') AND score >= 40 AND contains(lower(title), 'the') AND contains(lower(title), 'an')""")
def p1(t):
    return fd.feed_filter(t.feed, F.lit(datetime(2024, 1, 10)), {"source": ["click", "view"], "kind": ["en", "fr"]}, 40, "The an").select("id", "source", "kind", "score")


@query("p2_named_view", views="feed", sql="SELECT id FROM feed WHERE (source = 'purchase' AND kind = 'de') OR (topic IN ('src1', 'src2') AND source IN ('error', 'signup'))")
def p2(t):
    return t.feed.where(fd.in_view([{"source": ["purchase"], "kind": ["de"]}, {"topic": ["src1", "src2"], "source": ["error", "signup"]}])).select("id")


@query("p3_lookback", sql="SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16 06:00:00' GROUP BY 1")
def p3(t):
    bound = fd.since_bound("2w", datetime(2024, 1, 30, 6), timedelta(days=21))
    return t.events.where(F.col("ts") >= F.lit(bound)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("p8_exclude_globs", sql="""
WITH d AS (SELECT DISTINCT c_name FROM customer WHERE regexp_matches(c_name, '^Customer#0000.*7$|^.*99$'))
SELECT (SELECT count(*) FROM customer WHERE NOT regexp_matches(c_name, '^Customer#0000.*7$|^.*99$')) AS kept, count(*) AS ids, sum(('0x' || substr(sha256(c_name), 1, 12))::BIGINT)::VARCHAR AS digest FROM d""")
def p8(t):
    kept, dropped = so.exclude_globs(t.customer, "c_name", ["Customer#0000*7", "*99"])
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(dropped))  # each is one row


@query("p9_current_only", sql="SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 0 AND NOT (s_suppkey % 10 = 3) GROUP BY 1")
def p9(t):
    superseded = t.supplier.withColumn("superseded_by", F.when(F.col("s_suppkey") % 10 == 3, F.col("s_suppkey") + 1))
    return superseded.where("superseded_by is null and s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("n"))


@query("p10_exclude_ranges", sql="SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderkey >= 100 AND o_orderkey < 500) AND NOT (o_orderkey >= 2000 AND o_orderkey < 2500) GROUP BY 1")
def p10(t):
    ranges = [tuple(map(int, x.split(":"))) for x in "100:500,2000:2500".split(",")]
    kept = t.orders
    for low, high in ranges:
        kept = kept.where(~((F.col("o_orderkey") >= low) & (F.col("o_orderkey") < high)))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("p12_finite_stats", sql="""SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value)) AS bad, round(min(value), 6) AS low, round(max(value), 6) AS high, min(value) = max(value) AS constant, count(*) FILTER (abs(value) > 40) AS over FROM events GROUP BY 1""")
def p12(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("bad"), r6(F.min(v)).alias("low"), r6(F.max(v)).alias("high"), (F.min(v) == F.max(v)).alias("constant"), F.count_if(F.abs(v) > 40).alias("over"))


@query("p13_quantize", views="px", sql="""
WITH m AS (SELECT map_id, max(v) AS hi, CASE WHEN max(v) <= 1 THEN 1 WHEN max(v) <= 255 THEN 255 ELSE 65535 END AS full_scale FROM px GROUP BY 1)
SELECT map_id, round_even(v / CAST(full_scale AS DOUBLE) * 15, 0)::INT AS level, count(*) AS n FROM px JOIN m USING (map_id) GROUP BY 1, 2""")
def p13(t):
    top = t.px.groupBy("map_id").agg(F.max("v").alias("hi"))
    scale = F.when(F.col("hi") <= 1, 1).when(F.col("hi") <= 255, 255).otherwise(65535)
    return t.px.join(top, "map_id").groupBy("map_id", F.bround(F.col("v") / scale * 15).cast("int").alias("level")).agg(F.count("*").alias("n"))


@query("p14_public_gate", sql="""
WITH r AS (SELECT concat_ws(',', CASE WHEN contains(lower(p_name), 'blue') THEN 'blue' END, CASE WHEN contains(lower(p_name), 'red') THEN 'red' END, CASE WHEN contains(lower(p_name), 'widget') THEN 'widget' END) AS reason FROM part)
SELECT nullif(reason, '') AS reason, count(*) AS n FROM r GROUP BY 1""")
def p14(t):
    return so.public_gate(t.part, "p_name", ["widget", "red", "blue"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("p7_valid_mask", views="px", sql="SELECT y, x, count(*) AS maps FROM px GROUP BY 1, 2 HAVING count(*) FILTER (v IS NULL) = 0 AND count(*) FILTER (v <> 0) = 3")
def p7(t):
    return t.px.groupBy("y", "x").agg(F.count("*").alias("maps"), F.count_if(F.col("v").isNull()).alias("bad"), F.count_if(F.col("v") != 0).alias("used")).where("bad = 0 and used = 3").select("y", "x", "maps")


@query("p6_exclude_boxes", views="px", sql="""
WITH b AS (SELECT s_suppkey * 37 AS y0, s_suppkey * 37 + 5 AS y1, s_suppkey * 11 % 50 AS x0, s_suppkey * 11 % 50 + 8 AS x1 FROM supplier), k AS (SELECT *, EXISTS (SELECT 1 FROM b WHERE y BETWEEN y0 - 2 AND y1 + 2 AND x BETWEEN x0 - 2 AND x1 + 2) AS cut FROM px)
SELECT map_id, count(*) FILTER (cut) AS removed, count(*) FILTER (NOT cut) AS kept, round(sum(ink) FILTER (NOT cut)::DOUBLE / sum(ink), 6) AS ink_kept FROM k GROUP BY 1""")
def p6(t):
    y, x = F.col("s_suppkey") * 37, F.col("s_suppkey") * 11 % 50
    cut = gr.exclude_boxes(t.px, t.supplier.select(y.alias("y0"), (y + 5).alias("y1"), x.alias("x0"), (x + 8).alias("x1")), 2)
    return cut.groupBy("map_id").agg(F.count_if("cut").alias("removed"), F.count_if(~F.col("cut")).alias("kept"), r6(F.sum(F.when(~F.col("cut"), F.col("ink"))) / F.sum("ink")).alias("ink_kept"))


@query("t1_ranked", views="feed", sql="SELECT id, score, popularity FROM feed ORDER BY score DESC, ts DESC, id LIMIT 25 OFFSET 10")
def t1(t):
    return fd.ranked(t.feed, [F.desc("score"), F.desc("ts"), F.asc("id")], 25, 10).select("id", "score", "popularity")


@query("t2_briefing", views="feed", sql="""
WITH s AS (SELECT topic, count(*) AS size FROM feed GROUP BY 1), b AS (SELECT title, topic, id, score, row_number() OVER (PARTITION BY title ORDER BY size DESC, topic DESC, score DESC, id) AS rn FROM feed JOIN s USING (topic)),
p AS (SELECT topic, id, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) AS place FROM b WHERE rn = 1)
SELECT * FROM p WHERE place <= 3""")
def t2(t):
    return fd.briefing(t.feed, 3)


@query("t4_keep_top_share", sql="""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_custkey, c_nationkey FROM r WHERE rn <= round_even(n * CAST(0.2 AS DOUBLE), 0)""")
def t4(t):
    w = W.partitionBy("c_nationkey")
    r = t.customer.withColumns({"rn": F.row_number().over(w.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")), "n": F.count("*").over(w)})
    return r.where(F.col("rn") <= F.bround(F.col("n") * 0.2)).select("c_custkey", "c_nationkey")


@query("t5_listing", sql="SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_type = 'ECONOMY' ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20")
def t5(t):
    return fd.ranked(t.part.where("p_type = 'ECONOMY'"), [F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")], 20).select("p_partkey", "p_brand", "p_retailprice")


@query("t8_every_kth", sql="WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_orderstatus FROM r WHERE rn % 50 = 0")
def t8(t):
    rn = F.row_number().over(W.partitionBy("o_orderstatus").orderBy("o_orderkey"))
    return t.orders.select("o_orderkey", "o_orderstatus", rn.alias("rn")).where("rn % 50 = 0").drop("rn")


@query("t9_spread_pick", sql="""
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 3 OR i IN (0, (n - 1) // 2, n - 1)""")
def t9(t):
    w = W.partitionBy("o_custkey")
    r = t.orders.select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return r.where((F.col("n") <= 3) | (F.col("i") == 0) | (F.col("i") == F.floor((F.col("n") - 1) / 2)) | (F.col("i") == F.col("n") - 1)).select("o_custkey", "o_orderkey")


@query("u1_snapshot_diff", views="cat_old cat_new", sql="""
SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'gone' ELSE 'changed' END AS change FROM cat_old o FULL JOIN cat_new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.val <> n.val OR o.grp <> n.grp""")
def u1(t):
    return so.snapshot_diff(t.cat_old, t.cat_new, "id", ["grp", "val"])


@query("u2_incremental", views="cat_old cat_new", sql="""
SELECT n.id, n.grp, n.val, CASE WHEN o.grp = n.grp AND o.val = n.val THEN 'keep' ELSE 'measure' END AS action, CASE WHEN o.grp = n.grp AND o.val = n.val THEN o.val END AS carried_val FROM cat_new n LEFT JOIN cat_old o ON o.id = n.id""")
def u2(t):
    return so.incremental(t.cat_new, t.cat_old, "id", ["grp", "val"], ["val"])


@query("u4_dedup_by_hash", sql="SELECT sha256(text) AS hash, min(doc_id) AS keep, count(*) AS copies, max(length(text)) AS size FROM documents GROUP BY 1")
def u4(t):
    return so.dedup_by_hash(t.documents, "text", "doc_id")


@query("u5_dedup_stories", views="feed", sql="""
WITH r AS (SELECT id, regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '', 'g') AS story, score, row_number() OVER (PARTITION BY regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '', 'g') ORDER BY score DESC, id) AS rn FROM feed) SELECT id, score FROM r WHERE rn = 1""")
def u5(t):
    return fd.dedup_stories(t.feed, "title", [F.desc("score"), F.asc("id")]).select("id", "score")


@query("u6_merge_secondary", views="cat_old cat_new", sql="""
SELECT o.id, coalesce(CASE WHEN o.id % 4 <> 0 THEN o.val END, n.val) AS val, n.id IS NOT NULL AS folded FROM cat_old o LEFT JOIN cat_new n ON o.id = n.id UNION ALL SELECT n.id, n.val, false FROM cat_new n WHERE n.id NOT IN (SELECT id FROM cat_old)""")
def u6(t):
    return so.merge_secondary(t.cat_old.withColumn("val", F.when(F.col("id") % 4 != 0, F.col("val"))), t.cat_new, "id", ["val"])


@query("u8_pick_current", sql="WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE rn = 1")
def u8(t):
    return so.pick_current(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("u9_merge_registry", views="cat_old cat_new", sql="SELECT coalesce(n.id, o.id) AS id, coalesce(n.val, o.val) AS val, coalesce(n.grp, o.grp) AS grp, (o.id IS NOT NULL)::BIGINT + (n.id IS NOT NULL)::BIGINT AS sources FROM cat_old o FULL JOIN cat_new n ON o.id = n.id")
def u9(t):
    return so.merge_registry(t.cat_old, t.cat_new, "id", ["val", "grp"])


@query("u11_chunk_holdout", sql="""
WITH c AS (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 2000.0)::INT)) AS chunk FROM documents WHERE length(text) > 0)
SELECT doc_id, chunk::INT AS chunk, length(substring(text, chunk * 2000 + 1, 2000)) AS n_chars, chunk % 5 = 4 AS held_out FROM c""")
def u11(t):
    return so.chunk_holdout(t.documents, "doc_id", "text", 2000, 5)


@query("u11_hash_split", sql="SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey || '|9'), 1, 8))::BIGINT % 100 < 15 AS held_out FROM orders")
def u11b(t):
    return so.hash_split(t.orders.select("o_orderkey"), "o_orderkey", 15, 9)


@query("j11_reconcile", views="cat_old cat_new", sql="SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'superseded' WHEN o.id IS NULL THEN 'listing-only' ELSE 'current' END AS era FROM cat_old o FULL JOIN cat_new n ON o.id = n.id")
def j11(t):
    return so.reconcile(t.cat_old, t.cat_new, "id")


@query("j12_orphans", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)")
def j12(t):
    used = t.orders.where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(used, "c_custkey", "left_anti")


@query("j13_eligibility", sql="""
WITH l AS (SELECT n_nationkey AS list_id, upper(regexp_replace(n_name, '[^A-Za-z0-9]+', '', 'g')) AS key FROM nation) SELECT s_suppkey, string_agg(list_id::VARCHAR, ',' ORDER BY list_id) AS lists FROM supplier JOIN l ON l.key = 'NATION' || s_nationkey OR (l.key = 'NATION' || (s_nationkey // 10) AND s_nationkey >= 10) GROUP BY 1""")
def j13(t):
    flat = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))
    lists = t.nation.select(F.col("n_nationkey").alias("list_id"), flat("n_name").alias("key"))
    # exact name, and base name without the last digit: two equi-join keys instead of a prefix comparison of all pairs
    name = F.concat(F.lit("NATION"), F.col("s_nationkey").cast("string"))
    keys = F.array_distinct(F.array_compact(F.array(name, F.when(F.col("s_nationkey") >= 10, F.expr("concat('NATION', s_nationkey div 10)")))))
    return t.supplier.select("s_suppkey", F.explode(keys).alias("key")).join(lists, "key").groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("list_id")), lambda x: x.cast("string")), ",").alias("lists"))


@query("j14_exposure", sql="""
WITH e AS (SELECT p_brand AS scroll, p_type AS segment, max(p_size) AS level FROM part WHERE p_size > 45 GROUP BY 1, 2), w AS (SELECT p_brand AS scroll, max(p_size) AS level FROM part WHERE p_size < 10 GROUP BY 1)
SELECT DISTINCT p_brand AS scroll, p_type AS segment, coalesce(e.level, w.level, 0) AS level FROM part LEFT JOIN e ON e.scroll = p_brand AND e.segment = p_type LEFT JOIN w ON w.scroll = p_brand""")
def j14(t):
    records = t.part.where("p_size > 45").select(F.col("p_brand").alias("scroll"), F.col("p_type").alias("segment"), F.col("p_size").alias("level")).unionByName(t.part.where("p_size < 10").select(F.col("p_brand").alias("scroll"), F.lit(None).cast("string").alias("segment"), F.col("p_size").alias("level")))
    return so.exposure(t.part.select(F.col("p_brand").alias("scroll"), F.col("p_type").alias("segment")).distinct(), records)


@query("j20_plan_rows", views="bill", sql="""
WITH i AS (SELECT DISTINCT l_orderkey * 3 AS job_id FROM lineitem) SELECT i.job_id, CASE WHEN state IS NULL THEN 'missing' WHEN state = 'finished' THEN 'done' ELSE 'running' END AS plan FROM i LEFT JOIN bill USING (job_id)""")
def j20(t):
    return so.plan_rows(t.bill, t.lineitem.select((F.col("l_orderkey") * 3).alias("job_id")), "job_id")


@query("j22_lookup", sql="""
SELECT 'customer' AS kind, c_name AS detail FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'order', o_orderpriority FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'supplier', s_name FROM supplier WHERE s_suppkey = 7""")
def j22(t):
    return so.lookup("7", {"customer": (t.customer, "c_custkey", "c_name"), "order": (t.orders, "o_custkey", "o_orderpriority"), "supplier": (t.supplier, "s_suppkey", "s_name")})


@query("j10_latest_update", sql="""
WITH i AS (SELECT event_id AS id, user_id AS who, ts FROM events WHERE event_type = 'purchase'), a AS (SELECT event_id AS act_id, user_id AS who, ts AS "at", value > 10 AS has_text FROM events WHERE event_type = 'click'),
j AS (SELECT i.id, a.act_id, a."at", row_number() OVER (PARTITION BY i.id ORDER BY has_text DESC, a."at" DESC, act_id DESC) AS rn, count(*) OVER (PARTITION BY i.id) AS candidates FROM i JOIN a ON a.who = i.who AND a."at" BETWEEN i.ts - INTERVAL 12 HOURS AND i.ts + INTERVAL 12 HOURS)
SELECT id, act_id, "at", candidates FROM j WHERE rn = 1""")
def j10(t):
    items = t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("who"), "ts")
    acts = t.events.where("event_type = 'click'").select(F.col("event_id").alias("act_id"), F.col("user_id").alias("who"), F.col("ts").alias("at"), (F.col("value") > 10).alias("has_text"))
    return fd.latest_update(items, acts, "12 hours")


@query("r4_timeline", sql="""
WITH b AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-14 18:00:00', INTERVAL 6 HOURS)) AS bin), s AS (SELECT DISTINCT event_type AS source FROM events),
c AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS bin, event_type AS source, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT b.bin, s.source, coalesce(n, 0) AS n FROM b CROSS JOIN s LEFT JOIN c ON c.bin = b.bin AND c.source = s.source""")
def r4(t):
    return fd.timeline(t.events.select("ts", F.col("event_type").alias("source")), "6 hours", datetime(2024, 1, 5), datetime(2024, 1, 15))


@query("r5_source_status", sql="""
WITH r AS (SELECT event_type AS source, date_trunc('day', ts) AS day, count(*) AS read, count(*) FILTER (value > 5) AS kept, max(ts) AS finished FROM events GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS rn FROM r)
SELECT source, read, kept, finished, finished + INTERVAL 30 MINUTES AS next_due, CASE WHEN kept = 0 THEN 'error' WHEN kept < read THEN 'partial' ELSE 'ok' END AS state FROM l WHERE rn = 1""")
def r5(t):
    runs = t.events.groupBy(F.col("event_type").alias("source"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("read"), F.count_if(F.col("value") > 5).alias("kept"), F.max("ts").alias("finished"))
    last = so.pick_current(runs, "source", ["day"])
    return last.select("source", "read", "kept", "finished", (F.col("finished") + F.expr("interval 30 minutes")).alias("next_due"), F.when(F.col("kept") == 0, "error").when(F.col("kept") < F.col("read"), "partial").otherwise("ok").alias("state"))


@query("r10_works_by_day", sql="SELECT user_id AS who, event_type AS source, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS items, round(max(value), 4) AS best FROM events GROUP BY 1, 2, 3")
def r10(t):
    return t.events.groupBy(F.col("user_id").alias("who"), F.col("event_type").alias("source"), F.window("ts", "1 day")["start"].alias("day")).agg(F.count("*").alias("items"), F.round(F.max("value"), 4).alias("best"))


@query("s9_flatten_catalog", sql="""SELECT event_type, (json_extract(props, '$.k')::INT) // 10 AS k, count(*) AS n, count(*) FILTER (value > 10) AS large FROM events GROUP BY 1, 2""")
def s9(t):
    nested = t.events.select("event_type", "value", F.from_json("props", "map<string,int>").alias("p")).select("event_type", "value", F.explode("p").alias("key", "k")).where("key = 'k'")
    return nested.groupBy("event_type", F.floor(F.col("k") / 10).cast("int").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("large"))


@query("s6_safe_cells", sql="""
WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || left(text, 12) AS cell FROM conversations UNION ALL SELECT doc_id, -1, (doc_id - 500)::VARCHAR FROM documents)
SELECT conv_id, turn, CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(cell, '^[+-]?[0-9]+(\\.[0-9]+)?$') THEN '''' || cell ELSE cell END AS cell FROM c""")
def s6(t):
    head = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    cells = t.conversations.select("conv_id", "turn", F.concat(head, F.substring("text", 1, 12)).alias("cell")).unionByName(t.documents.select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), (F.col("doc_id") - 500).cast("string").alias("cell")))
    return cells.select("conv_id", "turn", tx.safe_cell(F.col("cell")).alias("cell"))


@query("s8_complete_folders", sql="""
SELECT 'order/' || l_orderkey AS folder, count(*) AS files FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0""")
def s8(t):
    keys = t.lineitem.select(F.concat_ws("/", F.lit("order"), F.col("l_orderkey"), F.col("l_returnflag")).alias("key"))
    parts = keys.select(F.regexp_extract("key", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("key", "([^/]+)$", 1).alias("name"))
    return parts.groupBy("folder").agg(F.collect_set("name").alias("names"), F.count("*").alias("files")).where(F.size(F.array_intersect("names", F.array(*map(F.lit, "ANR")))) == 3).select("folder", "files")


@query("s11_validate_records", sql="""
SELECT errors, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'balance' END, CASE WHEN NOT coalesce(c_mktsegment <> 'MACHINERY', false) THEN 'segment' END, CASE WHEN NOT coalesce(c_nationkey < 20, false) THEN 'nation' END) AS errors FROM customer) GROUP BY 1""")
def s11(t):
    rules = {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "MACHINERY", "nation": F.col("c_nationkey") < 20}
    return so.validate(t.customer, rules).groupBy("errors").agg(F.count("*").alias("n"))


@query("s12_uv_wide", sql="""
WITH r AS (SELECT l_orderkey AS tri, l_extendedprice AS u, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT tri, max(u) FILTER (i = 1) AS u1, max(v) FILTER (i = 1) AS v1, max(u) FILTER (i = 2) AS u2, max(v) FILTER (i = 2) AS v2, max(u) FILTER (i = 3) AS u3, max(v) FILTER (i = 3) AS v3 FROM r WHERE n = 3 GROUP BY 1""")
def s12(t):
    corner = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    tri = t.lineitem.groupBy(F.col("l_orderkey").alias("tri")).agg(F.array_sort(F.collect_list(corner)).alias("c")).where(F.size("c") == 3)
    return tri.select("tri", *[x for i in range(3) for x in (F.col("c")[i]["l_extendedprice"].alias(f"u{i + 1}"), F.col("c")[i]["l_quantity"].alias(f"v{i + 1}"))])


@query("s5_export_rows", views="feed", sql="SELECT who, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources, count(*) AS n FROM feed WHERE score >= 60 GROUP BY 1")
def s5(t):
    return t.feed.where("score >= 60").groupBy("who").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"), F.count("*").alias("n"))


@query("x1_clean_text", sql="""SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS n FROM pages""")
def x1(t):
    return t.pages.select("page_id", F.length(tx.clean_text(F.col("html"))).alias("n"))


@query("x2_code_links", sql="""
SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, 4 AS links, 'https://code.example.org/u' || page_id || '/repo; https://git.example.net/a/b' AS code FROM pages""")
def x2(t):
    page = F.col("page_id").cast("string")
    text = F.concat(F.lit("see "), "url", F.lit(" or <https://code.example.org/u"), page, F.lit("/repo> and \"https://code.example.org/short\" again "), "url", F.lit("\nhttps://git.example.net/a/b"))
    found = t.pages.select("page_id", text.alias("text"))
    links = tx.links(F.col("text"))
    code = tx.code_links(F.col("text"), ["code.example.org", "git.example.net"])
    return found.select("page_id", tx.url_host(tx.safe_url(links[0])).alias("host"), F.size(links).alias("links"), F.array_join(code, "; ").alias("code"))


@query("x3_unwrap", sql="SELECT page_id, url AS target FROM pages")
def x3(t):
    wrapped = F.concat(F.lit("https://click.example.com/r?x=1&url="), F.url_encode("url"))
    return t.pages.select("page_id", tx.unwrap_url(wrapped).alias("target"))


_TERMS = {"core": (["the", "and"], 15, 30), "topic": (["with", "from", "this"], 10, 20), "form": (["for", "that"], 5, 10)}


@query("x4_keyword_score", sql="""
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
p AS (SELECT doc_id, least(len(list_intersect(w, ['the', 'and'])) * 15, 30) AS core, least(len(list_intersect(w, ['with', 'from', 'this'])) * 10, 20) AS topic, least(len(list_intersect(w, ['for', 'that'])) * 5, 10) AS form, len(list_intersect(w, ['idiot', 'moron'])) * 25 AS cost FROM w)
SELECT doc_id, CASE WHEN core > 0 THEN greatest(0, least(100, core + topic + form - cost)) ELSE 0 END::INT AS score, concat_ws(',', CASE WHEN core > 0 THEN 'core:' || core END, CASE WHEN topic > 0 THEN 'topic:' || topic END, CASE WHEN form > 0 THEN 'form:' || form END) AS parts FROM p""")
def x4(t):
    score, parts = tx.keyword_score(F.col("text"), _TERMS, ["idiot", "moron"], 25)
    gate = F.exists("parts", lambda p: (p["label"] == "core") & (p["points"] > 0))  # without a core term nothing counts
    scored = t.documents.select("doc_id", score.alias("score"), parts.alias("parts"))
    told = F.transform(F.filter("parts", lambda p: p["points"] > 0), lambda p: F.concat_ws(":", p["label"], p["points"].cast("string")))
    return scored.select("doc_id", F.when(gate, F.col("score")).otherwise(0).cast("int").alias("score"), F.array_join(told, ",").alias("parts"))


@query("x5_finish_scores", views="feed", sql="""
SELECT id, CASE WHEN length(title) > 5000 AND score < 30 THEN least(score, 10) ELSE greatest(score, (score + floor(popularity)::INT) // 2) END AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS band FROM feed""")
def x5(t):
    blend = F.floor((F.col("score") + F.floor("popularity").cast("int")) / 2).cast("int")
    fused = F.when((F.length("title") > 5000) & (F.col("score") < 30), F.least("score", F.lit(10))).otherwise(F.greatest(F.col("score"), blend))
    return t.feed.select("id", fused.alias("score"), F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").otherwise("low").alias("band"))


@query("x6_parse_time", sql="SELECT o_orderkey, o_orderdate AS ts FROM orders")
def x6(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"))
    return t.orders.select("o_orderkey", tx.parse_time(text).alias("ts"))


@query("x7_norm_name", sql="SELECT n_nationkey, 'NATION' || CASE WHEN n_nationkey < 10 THEN '000' ELSE '00' END || n_nationkey AS name FROM nation")
def x7(t):
    return t.nation.select("n_nationkey", tx.norm_name("n_name").alias("name"))


@query("x8_letters_only", sql="""
SELECT doc_id, md5(trim(regexp_replace(upper(translate(text, 'ßàáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'saaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')), '[^A-Z]+', ' ', 'g'))) AS letters FROM documents""")
def x8(t):
    return t.documents.select("doc_id", F.md5(tx.letters_only(F.col("text"))).alias("letters"))


@query("x9_letter_hits", sql="SELECT p_partkey, (SELECT count(*) FROM range(1, least(length(p_name), length(p_type)) + 1) r(i) WHERE substr(p_name, i, 1) = substr(lower(p_type), i, 1)) AS hits FROM part")
def x9(t):
    return t.part.select("p_partkey", tx.letter_hits(F.col("p_name"), F.lower("p_type")).cast("long").alias("hits"))


@query("x10_cer", sql="SELECT p_brand, sum(levenshtein(p_name, lower(p_type)))::BIGINT AS edits, sum(length(p_type))::BIGINT AS letters, round(sum(levenshtein(p_name, lower(p_type))) / sum(length(p_type))::DOUBLE, 6) AS cer FROM part GROUP BY 1")
def x10(t):
    d = F.levenshtein("p_name", F.lower("p_type"))
    return t.part.groupBy("p_brand").agg(F.sum(d).alias("edits"), F.sum(F.length("p_type")).alias("letters"), r6(F.sum(d) / F.sum(F.length("p_type"))).alias("cer"))


@query("x12_numbers", sql="""
WITH n AS (SELECT conv_id, turn, unnest(regexp_extract_all(text || ' 12.50% of ' || conv_id, '([0-9]+(?:\\.[0-9]+)?%?)', 1)) AS token FROM conversations)
SELECT conv_id, turn, count(*) AS n, round(sum(replace(token, '%', '')::DOUBLE), 6) AS total, count(*) FILTER (token LIKE '%\\%' ESCAPE '\\') AS percents FROM n GROUP BY 1, 2""")
def x12(t):
    text = F.concat(F.col("text"), F.lit(" 12.50% of "), F.col("conv_id").cast("string"))
    n = t.conversations.select("conv_id", "turn", F.explode(tx.numbers(text)).alias("n"))
    return n.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), r6(F.sum("n.value")).alias("total"), F.count_if("n.percent").alias("percents"))


@query("x14_blocks", sql="""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents) SELECT doc_id, i::INT AS block, length(line) AS n_chars, line LIKE '% | %' AS table_row FROM l WHERE trim(line) <> ''""")
def x14(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    return lines.where(F.trim("line") != "").select("doc_id", "block", F.length("line").alias("n_chars"), F.col("line").contains(" | ").alias("table_row"))


@query("x15_fingerprint", sql="""
WITH a AS (SELECT source, doc_id // 1000 AS k, sha256(string_agg(doc_id || ':' || md5(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2), b AS (SELECT source, k // 1000 AS k, sha256(string_agg(k || ':' || h, ',' ORDER BY k)) AS h FROM a GROUP BY 1, 2), c AS (SELECT source, k // 1000 AS k, sha256(string_agg(k || ':' || h, ',' ORDER BY k)) AS h FROM b GROUP BY 1, 2)
SELECT source, sha256(string_agg(k || ':' || h, ',' ORDER BY k)) AS digest FROM c GROUP BY 1""")
def x15(t):
    """A digest of digests: a group at a level holds at most a thousand ranges of ids, whatever the source's size (up to 10 ** 12 ids)."""
    level = t.documents.select("source", F.col("doc_id").alias("k"), F.md5("text").alias("h"))
    for by in (["source", "up"], ["source", "up"], ["source", "up"], ["source"]):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: F.concat_ws(":", x["k"].cast("string"), x["h"])), ",")
        level = level.withColumn("up", F.floor(F.col("k") / 1000)).groupBy(*by).agg(F.sha2(joined, 256).alias("h")).withColumnRenamed("up", "k")
    return level.select("source", F.col("h").alias("digest"))


@query("x16_said", sql="SELECT conv_id, turn, left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 80) AS said FROM conversations")
def x16(t):
    k = F.col("conv_id") % 4  # planted around the text: a comment, a fence, quoted lines
    wrapped = F.when(k == 0, F.concat(F.lit("<!-- a\nnote -->"), "text")).when(k == 1, F.concat("text", F.lit("\n```py\nx > 1\n``` "))).when(k == 2, F.concat(F.lit("> said before\n> by others\n"), "text")).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", tx.said(wrapped, 80).alias("said"))


@query("x13_wording", sql="""
WITH s AS (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM documents) SELECT doc_id, count(*) AS sentences,
 count(*) FILTER (regexp_matches(lower(s), '(^|[^\\p{L}\\p{N}_])(worthless|pathetic|idiot)([^\\p{L}\\p{N}_]|$)') AND NOT regexp_matches(lower(s), '(^|[^\\p{L}\\p{N}_])(not|no|never|nor)([^\\p{L}\\p{N}_]|$)')) AS findings FROM s GROUP BY 1""")
def x13(t):
    s = t.documents.select("doc_id", F.explode(F.split("text", r"\. ")).alias("s"))
    bad = tx.has_word(F.col("s"), ["worthless", "pathetic", "idiot"]) & ~tx.has_word(F.col("s"), ["not", "no", "never", "nor"])
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(bad).alias("findings"))


@query("j17_match_claims", sql="""
WITH c AS (SELECT o_orderkey, o_custkey, round(o_totalprice / 1000, 0) AS stated FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice / 1000, 0) + 1 FROM orders WHERE o_orderkey % 3 = 0)
SELECT c.o_orderkey, c.stated, abs(o.o_totalprice / 1000 - c.stated) <= 0.5 AS supported FROM c JOIN orders o ON c.o_orderkey = o.o_orderkey""")
def j17(t):
    claims = t.orders.select("o_orderkey", (F.round(F.col("o_totalprice") / 1000, 0) + (F.col("o_orderkey") % 3 == 0).cast("int")).alias("stated"))
    return claims.join(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_orderkey", "stated", (F.abs(F.col("o_totalprice") / 1000 - F.col("stated")) <= 0.5).alias("supported"))


@query("r7_ledger_append", views="bill", sql="SELECT job_id, cost FROM bill WHERE job_id % 5 <> 0")
def r7(t):
    batch = t.bill.select("job_id", "cost")
    return so.ledger_append(t.bill.where("job_id % 5 = 0").select("job_id", "cost"), batch.unionByName(batch), "job_id")


@query("q7_expectations", views="cat_old cat_new", sql="SELECT id, 'missing' AS finding FROM cat_old WHERE id NOT IN (SELECT id FROM cat_new) UNION ALL SELECT id, 'unexpected' FROM cat_new WHERE id NOT IN (SELECT id FROM cat_old)")
def q7(t):
    old, new = t.cat_old.select("id"), t.cat_new.select("id")
    return old.join(new, "id", "left_anti").withColumn("finding", F.lit("missing")).unionByName(new.join(old, "id", "left_anti").withColumn("finding", F.lit("unexpected")))
