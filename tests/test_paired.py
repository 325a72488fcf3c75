"""Paired readouts and their controls against numpy over the same draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import paired
from spindrift.operators import resampling as rs


def test_readout_like_numpy(spark):
    rng = random.Random(4)
    rows = [(i % 8, float(rng.randrange(-3, 9)) if rng.random() < 0.95 else None) for i in range(400)] + [(None, 5.0), (3, float("nan"))]
    df = spark.createDataFrame(rows, "cluster int, d double")
    got = paired.paired_readout(df, F.col("d"), "cluster", 8, 50, 3).first()
    d = {u: [x for c, x in rows if c == u and x is not None and x == x] for u in range(8)}
    flat = [x for v in d.values() for x in v]
    assert (got["n"], got["clusters"], got["share"], got["median"]) == (len(flat), 8, pytest.approx(np.mean(np.array(flat) > 0)), np.median(flat))
    weights = {}
    for r in rs.resample_weights(spark.range(8).select(F.col("id").alias("unit")), 8, 50, 3).collect():
        weights.setdefault(r["draw"], []).extend(d[r["unit"]] * r["weight"])
    shares, medians = [np.mean(np.array(x) > 0) for x in weights.values()], [np.median(x) for x in weights.values()]
    for name, values in (("share", shares), ("median", medians)):
        assert got[f"{name}_low"] == pytest.approx(np.quantile(values, 0.025)) and got[f"{name}_high"] == pytest.approx(np.quantile(values, 0.975))
    assert got["passes"] == bool(got["share_low"] > 0.5 and got["median_low"] > 0)
    clear = spark.createDataFrame([(i % 8, 1.0 + i % 3) for i in range(80)], "cluster int, d double")
    assert paired.paired_readout(clear, F.col("d"), "cluster", 8).first()["passes"]
    assert paired.sign_flips(clear, F.col("d"), "cluster", 8, 10, 20, 0.5).first()["holds"]
    none = paired.paired_readout(df.limit(0), F.col("d"), "cluster", 8).first()
    assert none["n"] == 0 and not none["passes"]


def test_controls(spark):
    df = spark.createDataFrame([(2.0, 1.0), (4.0, 1.0), (6.0, None)], "d double, e double")
    assert tuple(paired.degradation(df, F.col("d"), F.col("e")).first()) == (4.0, 1.0, True)
    assert not paired.degradation(df, F.col("d"), F.col("d") - 1).first()["holds"]
    assert paired.degradation(df, -F.col("d"), F.col("e")).first()["holds"] is None and paired.degradation(df.limit(0), F.col("d"), F.col("e")).first()["holds"] is None
    assert tuple(paired.border_share(df, F.col("d") == 2, 0.5).first()) == (3, 1, pytest.approx(1 / 3), True)
    assert paired.border_share(df.limit(0), F.col("d") == 2).first()["holds"] is None
