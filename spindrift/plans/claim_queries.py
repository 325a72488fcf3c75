"""Queries of blocks and of claims that are checked against sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims
from .registry import query

_BLOCKS = r"""li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {table}),
fl AS (SELECT *, regexp_matches(line, '^\s*($|#|>|<!--)') OR (regexp_matches(line, '^\s*\|.*\|\s*$') AND regexp_matches(line, '^[\s|:-]*$')) AS gap, regexp_matches(line, '^\s*\|.*\|\s*$') AS tr, regexp_matches(line, '^([-*+]|\d+[.)])\s+') AS item FROM li),
fi AS (SELECT *, NOT gap AND (tr OR item OR coalesce(lag(gap OR tr) OVER (PARTITION BY doc_id ORDER BY i), true)) AS first FROM fl), bl AS (SELECT *, max(CASE WHEN first THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM fi),
tx AS (SELECT doc_id, block, max(CASE WHEN first THEN CASE WHEN tr THEN 'row' WHEN item THEN 'item' ELSE 'paragraph' END END) AS kind, string_agg(CASE WHEN item THEN regexp_replace(line, '^([-*+]|\d+[.)])\s+', '') ELSE trim(line) END, ' ' ORDER BY i) AS text FROM bl WHERE NOT gap GROUP BY 1, 2),
ba AS (SELECT *, coalesce(nullif(array_to_string(regexp_extract_all(lower(CASE WHEN regexp_matches(text, '^\s*\*\*(.+?)\*\*') THEN regexp_extract(text, '^\s*\*\*(.+?)\*\*', 1) ELSE text END), '[a-z0-9]+')[1:8], '-'), ''), 'block') AS base FROM tx),
nm AS (SELECT doc_id, block, kind, text, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY block) AS n FROM ba))"""


@query("x14_document_blocks", sql=f"WITH {_BLOCKS.format(table='documents')} SELECT doc_id, block, kind, name, sha256(text) AS digest FROM nm")
def x14(t):
    found = claims.blocks(t.documents, "doc_id", "text")
    return found.select("doc_id", F.col("block").cast("long").alias("block"), "kind", "name", F.sha2("text", 256).alias("digest"))


# a note for each order, as a heading, a paragraph, two items and a table; every seventh states a wrong total
_NOTES = r"""nt AS (SELECT o_orderkey AS doc_id, '# Order ' || o_orderkey || chr(10) || chr(10) || 'Total of order ' || o_orderkey || chr(10) || 'was ' || CAST(floor(o_totalprice) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) || ' in all.' || chr(10) || '- **Customer ' || o_orderkey || '** is number ' || o_custkey || chr(10) || '- no figure here' || chr(10) || '| key | part |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderkey % 10 || '0% |' AS text FROM orders)"""


def _notes(t):
    k, total = F.col("o_orderkey"), (F.floor("o_totalprice") + (F.col("o_orderkey") % 7 == 0).cast("int")).cast("long").cast("string")
    s = lambda c: c.cast("string")
    parts = [F.concat(F.lit("# Order "), s(k)), F.lit(""), F.concat(F.lit("Total of order "), s(k)), F.concat(F.lit("was "), total, F.lit(" in all.")), F.concat(F.lit("- **Customer "), s(k), F.lit("** is number "), s(F.col("o_custkey"))), F.lit("- no figure here"), F.lit("| key | part |"), F.lit("| --- | --- |"), F.concat(F.lit("| "), s(k), F.lit(" | "), s(k % 10), F.lit("0% |"))]
    return t.orders.select(k.alias("doc_id"), F.array_join(F.array(*parts), "\n").alias("text"))


@query("x14_table_rows", sql=rf"WITH {_NOTES}, {_BLOCKS.format(table='nt')} SELECT doc_id, block, name, trim(string_split(regexp_replace(text, '^\||\|$', '', 'g'), '|')[1]) AS c0, trim(string_split(regexp_replace(text, '^\||\|$', '', 'g'), '|')[2]) AS c1 FROM nm WHERE kind = 'row'")
def x14_rows(t):
    found = claims.blocks(_notes(t), "doc_id", "text").where("kind = 'row'")
    return found.select("doc_id", F.col("block").cast("long").alias("block"), "name", F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"))


# paragraphs claim the order as source, items the customer; some sources are gone, changed or the note itself
@query("j17_findings", sql=rf"""
WITH {_NOTES}, {_BLOCKS.format(table='nt')}, nu AS (SELECT doc_id AS doc, name, unnest(regexp_extract_all(' ' || text, '[^\w.,](-?(\d{{1,3}}(,\d{{3}})+|\d+)(\.\d+)?%?)', 1)) AS token FROM nm WHERE kind <> 'row'),
n AS (SELECT doc, name, token, CAST(token AS DOUBLE) AS value FROM nu), le AS (SELECT 'total-of-order-' || o_orderkey || '-was-' || CAST(floor(o_totalprice) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) || '-in-all' AS name, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey || '' ELSE 'order ' || o_orderkey END AS source, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'd' || o_orderkey END AS pin FROM orders WHERE o_orderkey % 3 <> 0),
so AS (SELECT 'order ' || o_orderkey AS source, 'd' || o_orderkey AS digest, [floor(o_totalprice), o_orderkey::DOUBLE] AS vals FROM orders WHERE o_orderkey % 13 <> 0), us AS (SELECT DISTINCT n.doc, n.name, le.source, le.pin, le.source IN (SELECT o_orderkey || '' FROM orders) AS own FROM n JOIN le USING (name)),
hit AS (SELECT DISTINCT n.doc, n.name, n.token FROM n JOIN us ON us.doc = n.doc AND us.name = n.name AND NOT own JOIN so ON so.source = us.source, UNNEST(so.vals) x(v) WHERE x.v = n.value)
SELECT 'unsourced' AS code, doc, name, count(*)::VARCHAR AS detail FROM n WHERE name NOT IN (SELECT name FROM le) GROUP BY 2, 3 UNION ALL SELECT 'self', doc, name, source FROM us WHERE own
UNION ALL SELECT CASE WHEN so.source IS NULL THEN 'missing' ELSE 'changed' END, doc, name, us.source FROM us LEFT JOIN so USING (source) WHERE NOT own AND (so.source IS NULL OR digest <> pin)
UNION ALL SELECT DISTINCT 'unmatched', doc, name, token FROM n WHERE name IN (SELECT name FROM le) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc = n.doc AND hit.name = n.name AND hit.token = n.token)""")
def j17_findings(t):
    notes = _notes(t)
    stated = claims.stated_numbers(claims.blocks(notes, "doc_id", "text").where("kind <> 'row'").select(F.col("doc_id").alias("doc"), "name", "text"), "text")
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    total = s((F.floor("o_totalprice") + (k % 7 == 0).cast("int")).cast("long"))
    name = F.concat(F.lit("total-of-order-"), s(k), F.lit("-was-"), total, F.lit("-in-all"))
    ledger = t.orders.where("o_orderkey % 3 <> 0").select(name.alias("name"), F.when(k % 11 == 0, s(k)).otherwise(F.concat(F.lit("order "), s(k))).alias("source"), F.when(k % 5 == 0, "old").otherwise(F.concat(F.lit("d"), s(k))).alias("pin"))
    sources = t.orders.where("o_orderkey % 13 <> 0").select(F.concat(F.lit("order "), s(k)).alias("source"), F.concat(F.lit("d"), s(k)).alias("digest"), F.array(F.floor("o_totalprice").cast("double"), k.cast("double")).alias("values"))
    return claims.findings(stated, ledger, sources, notes.select(F.col("doc_id").alias("doc")))
