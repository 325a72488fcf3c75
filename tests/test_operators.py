from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.operators import feed, graph, grids, ngrams, setops, spatial, vectors


def test_box_scan_is_half_open(spark):
    df = spark.createDataFrame([(1, "A", 1.0, 0.0, 10.0), (2, "A", 1.0, 10.0, 20.0), (3, "A", 1.0, 20.0, 30.0)], "id int, family string, length_mm double, bmin_x double, bmax_x double")
    assert {r["id"] for r in spatial.box_scan(df, {"x": (10, 20)}).collect()} == {1, 2}


def test_layout_keeps_every_box(spark, tmp_path):
    df = spark.range(200).select("id", F.lit(1.0).alias("length_mm"), *[((F.col("id") * k) % 97).cast("double").alias(f"bmin_{a}") for a, k in zip("xyz", (3, 5, 7), strict=True)])
    df = df.withColumns({f"bmax_{a}": F.col(f"bmin_{a}") + 1 + F.col("id") % 40 for a in "xyz"})
    spatial.spatial_layout_write(df, str(tmp_path / "lake"), 8.0, 4)
    r = spatial.verify_layout(spark.read.parquet(str(tmp_path / "lake")), df).first()
    assert (r["rows"], r["ids"], r["twice"], r["lost"], r["foreign"]) == (200, 200, 0, 0, 0)
    short = spatial.verify_layout(df.where("id <> 7").unionByName(df.where("id = 9")), df).first()
    assert (short["twice"], short["lost"]) == (1, 1)


def test_components_and_contradictions(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    got = graph.components(spark.range(41).select(F.col("id").alias("node")), edges).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {0: 21, 21: 20}
    steps = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 2), (7, 8, 1), (8, 9, 1), (7, 9, 5), (4, 4, 0)], "a long, b long, k long")
    r = graph.consistency(steps).first()
    assert (r["components"], r["inconsistent"], r["self_loops"], r["conflicting_pairs"]) == (2, 1, 1, 0)


def test_closure_refuses_loops(spark):
    got = graph.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")).collect()
    assert all(r["child"] != r["ancestor"] for r in got) and len(got) == 6


def test_islands_and_arc(spark):
    df = spark.createDataFrame([("g", i, i not in (3, 4)) for i in range(8)], "g string, i int, f boolean")
    assert sorted((r["start"], r["stop"]) for r in grids.islands(df, ["g"], "i", F.col("f")).collect()) == [(0, 2), (5, 7)]
    arc = grids.largest_arc(spark.createDataFrame([("g", 1), ("g", 2), ("g", 9)], "g string, b int"), ["g"], "b", 12).first()
    assert arc["largest_arc"] == 6


def test_kneser_ney_matches_brute_force(spark):
    texts = ["ABAB", "ABC", "CAB"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = {r["d"]: r["bits"] for r in ngrams.kn_score(docs, "d", "t", ngrams.kn_model(docs, "t", 2), 4).collect()}
    import math
    from collections import Counter, defaultdict

    def table(c):
        n = Counter(c.values())
        y = n[1] / max(1, n[1] + 2 * n[2])
        d = [0, *[max(0.0, i - (i + 1) * y * n[i + 1] / max(1, n[i])) for i in (1, 2, 3)]]
        total, left = defaultdict(float), defaultdict(float)
        for g, k in c.items():
            total[g[:-1]] += k
            left[g[:-1]] += d[min(k, 3)]
        return {g: (k - d[min(k, 3)]) / total[g[:-1]] for g, k in c.items()}, {x: left[x] / total[x] for x in total}

    two = Counter(("^" + t)[i : i + 2] for t in texts for i in range(len(t)))
    one = Counter(g[1:] for g in two)
    (p2, b2), (p1, b1) = table(two), table(one)
    for d, t in enumerate(texts):
        bits = -sum(math.log2(p2[("^" + t)[i : i + 2]] + b2[("^" + t)[i]] * (p1[t[i]] + b1[""] / 4)) for i in range(len(t)))
        assert got[d] == pytest.approx(bits, abs=1e-9)


def test_similar_finds_the_same_as_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    got = vectors.similar(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 3, every=50, block=2).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for q in (0, 50, 100):
        best = sorted(((-round(cos(rows[q][1], v), 6), k) for k, v in rows if k != q))[:3]
        assert [r["k"] for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["place"])] == [k for _, k in best]


def test_lookback_and_text_functions(spark):
    now = datetime(2024, 1, 10)
    assert feed.since_bound("6h", now, timedelta(days=1)) == now - timedelta(hours=6)
    assert feed.since_bound("2w", now, timedelta(days=1)) == now - timedelta(days=1)
    row = spark.createDataFrame([("Name. 139", "=1+1", "-5", "<b>a&amp;b</b>  c")], "n string, f string, m string, h string").select(tx.norm_name(F.col("n")), tx.safe_cell(F.col("f")), tx.safe_cell(F.col("m")), tx.clean_text(F.col("h"))).first()
    assert tuple(row) == ("NAME0139", "'=1+1", "-5", "a&b c")


def test_ledger_writes_each_key_once(spark):
    ledger, batch = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert [tuple(r) for r in setops.ledger_append(ledger, batch, "k").collect()] == [("b", 4)]
    with pytest.raises(ValueError):
        setops.ledger_append(ledger, batch.withColumn("z", F.lit(1)), "k")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
