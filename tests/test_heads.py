"""Ridge heads by moments against plain numpy on the same folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import heads as hd

SCHEMA = "k long, v array<double>, n double, c string, y double"
PENALTIES = (0.1, 10.0, 1000.0)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("x", hd.features("v", ["n"], {"c": ["a", "b"]}))


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(240):
        v = rng.normal(size=4)
        c = "ab"[k % 2] if k % 7 else None
        rows.append((k, v.tolist(), float(rng.normal()), c, float(30 + 10 * v[0] - 5 * v[1] + (8 if c == "a" else 0) + rng.normal())))
    odd = [(None, [0.1, 0.2, 0.3, 0.4], float("nan"), "z", 31.0), (900, None, 1.0, "a", 5.0), (901, [1.0] * 4, None, "a", None), (902, [1.0] * 4, 1.0, "b", float("nan")), (903, [1.0, float("nan"), 0.0, 0.0], 1.0, "b", 3.0), (904, [1.0], 1.0, "b", 3.0)]
    return table(spark, rows + odd)


def ridge(x, y, penalty):
    z = np.column_stack([np.ones(len(x)), x])
    keep = np.eye(z.shape[1]) * penalty
    keep[0, 0] = 0
    return np.linalg.solve(z.T @ z + keep, z.T @ y)


def line(x, w):
    return w[0] + x @ w[1:]


def test_features_of_odd_values(rated):
    row = rated.where("k IS NULL").first()
    assert row["x"] == [0.1, 0.2, 0.3, 0.4, 0.0, 0.0, 0.0]
    assert rated.where("k = 900").first()["x"] is None and rated.where("k = 902").first()["x"][-2:] == [0.0, 1.0]
    assert hd.levels(rated, ["c"]) == {"c": ["a", "b", "z"]}
    with pytest.raises(ValueError):
        hd.levels(rated, ["c"], 2)


def test_nested_scores_by_loops(rated):
    rows, width = hd._rows(rated, "k", "y", F.col("x"), 3, 3, 2)
    folds = rows.collect()
    assert width == 7 and len(folds) == 2 * 241
    got = {(r["rep"], r["key"]): r for r in hd.nested_scores(rated, "k", "y", F.col("x"), 3, 3, 2, PENALTIES).collect()}
    assert len(got) == len(folds)
    for rep in range(2):
        part = [r for r in folds if r["rep"] == rep]
        x, y = np.array([r["x"] for r in part]), np.array([r["y"] for r in part])
        outer, inner = np.array([r["outer"] for r in part]), np.array([r["inner"] for r in part])
        for k in range(3):
            train = outer != k
            held = {}
            for p in PENALTIES:
                held[p] = np.zeros(len(y))
                for i in range(3):
                    held[p][inner == i] = line(x[inner == i], ridge(x[train & (inner != i)], y[train & (inner != i)], p))
            best = min(PENALTIES, key=lambda p: ((held[p] - y)[train] ** 2).sum())
            w = ridge(x[train], y[train], best)
            # the k-th share of n sorted values is the one at rank ceil(share * n), at least the first
            share = [max(1, int(np.ceil(i / 40 * train.sum() - 1e-9))) - 1 for i in range(41)]
            xs, ys = np.sort(held[best][train])[share], np.sort(y[train])[share]
            for at in np.flatnonzero(outer == k):
                r = got[rep, part[at]["key"]]
                assert r["penalty"] == best and r["raw"] == pytest.approx(line(x[at], w), abs=1e-6)
                assert r["score"] == pytest.approx(np.interp(r["raw"], xs, ys), abs=1e-6)


def test_report_by_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(rep, float(y), float(y + rng.integers(-3, 4))) for rep in range(3) for y in rng.integers(0, 12, 50)]
    got = hd.band_report(spark.createDataFrame(rows, "rep int, y double, score double"), 8).first()

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    rho, precision = [], []
    for rep in range(3):
        y, s = (np.array([r[i] for r in rows if r[0] == rep]) for i in (1, 2))
        rho.append(np.corrcoef(ranks(y), ranks(s))[0, 1])
        precision.append(((y >= 8) & (s >= 8)).sum() / max(1, (s >= 8).sum()))
    assert got["spearman"] == pytest.approx(np.mean(rho)) and got["spearman_sd"] == pytest.approx(np.std(rho))
    assert got["high_precision"] == pytest.approx(np.mean(precision)) and got["reps"] == 3


@pytest.mark.parametrize("how", ["quantile", "isotonic"])
def test_fitted_head_scores_rows(rated, how):
    head = hd.fit_head(rated, "k", "y", F.col("x"), penalties=PENALTIES, how=how)
    assert head.xs == sorted(head.xs) and head.ys == sorted(head.ys)
    got = {r["k"]: r["s"] for r in rated.select("k", head.apply(F.col("x")).alias("s")).collect()}
    assert got[900] is None and got[904] is None
    for r in rated.where("k < 240").collect():
        raw = line(np.array(r["x"]), np.array(head.weights))
        assert got[r["k"]] == pytest.approx(np.interp(raw, head.xs, head.ys), abs=1e-9)


def test_no_rows(spark, rated):
    empty = rated.limit(0)
    scored = hd.nested_scores(empty, "k", "y", F.col("x"))
    assert scored.count() == 0 and hd.band_report(scored, 1.0).count() == 0
    assert isinstance(scored.schema["score"].dataType, T.DoubleType)
    with pytest.raises(ValueError):
        hd.fit_head(empty, "k", "y", F.col("x"))
