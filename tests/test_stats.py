import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import resampling as rs
from spindrift.operators import stats as st


def pairs_auc(rows):
    pos, neg = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), rng.randrange(2)) for _ in range(200)]
    got = st.auc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first()
    assert got["auc"] == pytest.approx(pairs_auc(rows), abs=1e-6)


def test_auc_without_a_class_is_null(spark):
    assert st.auc(spark.createDataFrame([(1, 1), (2, 1)], "s int, y int"), "s", "y").first()["auc"] is None


def test_permuted_labels_are_near_half(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.randrange(2)) for _ in range(3000)]
    assert st.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"] == pytest.approx(0.5, abs=0.05)


def test_curve_area_is_the_auc(spark):
    rng = random.Random(3)
    rows = [("g", rng.randrange(9), rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, s int, y int")
    c = st.curve_stats(df, "s", "y", ["g"]).first()
    assert c["auc"] == pytest.approx(pairs_auc([r[1:] for r in rows]), abs=1e-6)
    assert c["auc_ties_lose"] <= c["auc"] <= c["auc_ties_win"]


def test_running_sums_cross_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("level"), F.lit(1).alias("n"))
    rows = st.running(df, [], "level", ["n"]).collect()
    assert all(r["n_before"] == r["level"] for r in rows)


def test_mid_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 9.0)], "k string, v double")
    assert {r["k"]: r["rank"] for r in st.mid_rank(df, "v", []).collect()} == {"a": 1.0, "b": 2.5, "c": 2.5, "d": 4.0}


def test_weights_sum_to_the_number_of_units(spark):
    w = rs.resample_weights(spark.range(7).select(F.col("id").alias("unit")), 7, 5)
    assert {r["n"] for r in w.groupBy("draw").agg(F.sum("weight").alias("n")).collect()} == {7}


def test_digest_ignores_order_and_sees_multiplicity(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (1,), (2,)], "x int")
    c = spark.createDataFrame([(1,), (2,)], "x int")
    one = lambda d: tuple(st.multiset_digest(d).first())
    assert one(a) == one(b) != one(c)


def test_units_and_smallest_hashes_like_sorting(spark):
    import hashlib

    from pyspark.sql import functions as F

    from spindrift.operators import resampling as rs

    keys = [i * 7 % 501 for i in range(900)]
    df = spark.createDataFrame([(k, f"k{k}") for k in keys], "key long, name string")
    units, n = rs.dense_units(df, "key")
    assert n == len(set(keys)) and {r["key"]: r["unit"] for r in units.collect()} == {k: i for i, k in enumerate(sorted(set(keys)))}
    assert rs.dense_units(df.limit(0), "key")[1] == 0
    order = sorted(set(keys), key=lambda k: hashlib.md5(f"k{k}".encode()).hexdigest())
    once = df.distinct()
    for n in (0, 1, 37, 500, 501, 9999):
        assert sorted(r["key"] for r in rs.smallest_by_hash(once, n, F.md5("name"), ["key"]).collect()) == sorted(order[:n])
