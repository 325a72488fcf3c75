"""The given tables, and views that Spark derives from them so that every operator has data at any scale.

The views' SQL uses only functions that Spark SQL and DuckDB share: one text serves the query and its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # a lattice of three maps, 64 wide and 64 high for each 3,072 orders: value, truth and supervision for each pixel
    "px": """
SELECT CAST(l_linenumber % 3 AS INT) AS map_id, CAST(FLOOR(l_orderkey / CAST(3072 AS DOUBLE)) * 64 + l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
       CAST(MAX(CAST(FLOOR(l_extendedprice) AS BIGINT) % 256) AS INT) AS v,
       MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ink, MAX(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS sup
FROM {lineitem} GROUP BY 1, 2, 3""",
    "scored_docs": """
SELECT d.doc_id, d.lang, d.source, d.n_chars AS score, l.quality AS label, l.toxic
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # one vertex for each order: meshes of 20 rows by 132 columns on a spiral of pitch 40; every 17th node is a hole
    "spiral": """
SELECT m, r, c, 1000 + (2000 + CAST(40 AS DOUBLE) * (m + c / CAST(120 AS DOUBLE))) * cos(c * pi() / 60) AS x,
       1000 + (2000 + CAST(40 AS DOUBLE) * (m + c / CAST(120 AS DOUBLE))) * sin(c * pi() / 60) AS y, CAST(100 + 10 * r AS DOUBLE) AS z
FROM (SELECT CAST(FLOOR(o_orderkey / CAST(2640 AS DOUBLE)) AS INT) AS m, CAST(FLOOR(o_orderkey % 2640 / CAST(132 AS DOUBLE)) AS INT) AS r, CAST(o_orderkey % 132 AS INT) AS c FROM {orders}) a
WHERE (m * 5 + r * 3 + c * 7) % 17 <> 0""",
    "boxes": """
SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag AS family, l_quantity AS length_mm,
       CAST(l_partkey % 1000 AS DOUBLE) AS bmin_x, CAST(l_partkey % 1000 AS DOUBLE) + l_quantity AS bmax_x,
       CAST(l_suppkey % 100 * 10 AS DOUBLE) AS bmin_y, CAST(l_suppkey % 100 * 10 AS DOUBLE) + l_quantity AS bmax_y,
       CAST(l_orderkey % 1000 AS DOUBLE) AS bmin_z, CAST(l_orderkey % 1000 AS DOUBLE) + l_quantity AS bmax_z
FROM {lineitem}""",
    # consistent potentials (id div 7) with a contradiction on every 97th order
    "steps": """
SELECT o_orderkey AS chain, o_custkey AS a, o_custkey + 1 + o_orderkey % 3 AS b,
       CAST(FLOOR((o_custkey + 1 + o_orderkey % 3) / CAST(7 AS DOUBLE)) - FLOOR(o_custkey / CAST(7 AS DOUBLE)) AS BIGINT) + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS k
FROM {orders}""",
    "feed": """
SELECT e.event_id AS id, e.event_type AS source, d.lang AS kind, d.source AS topic, d.text AS title,
       e.ts, CAST(e.event_id % 101 AS INT) AS score, e.user_id AS who, e.value AS popularity
FROM {events} e CROSS JOIN (SELECT COUNT(*) AS n FROM {documents}) k JOIN {documents} d ON e.event_id % k.n = d.doc_id""",
    "cat_old": "SELECT s_suppkey AS id, s_nationkey AS grp, s_acctbal AS val FROM {supplier} WHERE s_suppkey % 10 <> 3",
    "cat_new": "SELECT s_suppkey AS id, s_nationkey AS grp, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS val FROM {supplier} WHERE s_suppkey % 10 <> 5",
    "bill": """
SELECT o_orderkey AS job_id, o_orderpriority AS flavor, o_orderdate AS started, o_totalprice AS cost,
       CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'running' END AS state FROM {orders}""",
}

#: What Spark plans in place of a view's text. Joins with a hint are not put in another order: else a filter on events and
#: documents together joins these two first, as a product, before the count that makes the key.
PLANNED = {"feed": VIEWS["feed"].replace("SELECT", "SELECT /*+ BROADCAST(k) */", 1)}  # k is one row

#: Rows of lineitem in a partition of the lattice: above that many in each shuffle partition, the lattice has more partitions.
LINES = 500_000
#: That in every partition of :meth:`Tables.dealt_px`.
TASK_LINES = 250_000
#: The lattice in a stated number of partitions by y, which also serve groups and windows by y.
DEALT = """
SELECT map_id, y, x, MAX(v) AS v, MAX(ink) AS ink, MAX(sup) AS sup FROM (
SELECT /*+ REPARTITION(%d, y) */ CAST(l_linenumber %% 3 AS INT) AS map_id, CAST(FLOOR(l_orderkey / CAST(3072 AS DOUBLE)) * 64 + l_orderkey %% 64 AS INT) AS y, CAST(l_partkey %% 64 AS INT) AS x,
       CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) %% 256 AS INT) AS v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ink, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS sup
FROM {lineitem}) GROUP BY map_id, y, x"""

_TABLE = re.compile(r"\{(\w+)\}")


class Tables:
    """Tables and views of one data folder, as attributes; each is planned when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._frames = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in VIEWS:
                self._frames[name] = self._planned(self._dealt() if name == "px" else PLANNED.get(name, VIEWS[name]))
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def _planned(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: getattr(self, t) for t in set(_TABLE.findall(text))})

    def dealt_px(self) -> tuple[DataFrame, int]:
        """The lattice in partitions of TASK_LINES rows of lineitem on average, however many the session's shuffles have, and their number."""
        parts = self.lineitem.count() // TASK_LINES + 1
        return self._planned(DEALT % parts), parts

    def _dealt(self) -> str:
        parts = self.lineitem.count() // LINES + 1
        return DEALT % parts if parts > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else VIEWS["px"]


def oracle_views(names: list[str], sql: str) -> str:
    """sql behind the definitions of the views it names."""
    if not names:
        return sql
    heads = ", ".join(f"{n} AS ({_TABLE.sub(lambda m: m[1], VIEWS[n])})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
