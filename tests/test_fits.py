"""Fits, tests, learned scores, boxes and lines against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import fits, meshes, vectors
from spindrift.operators import grids as gr
from spindrift.operators import resampling as rs
from spindrift.operators import spatial as sp


def test_affine_fit_and_leave_one_out(spark):
    rng = np.random.default_rng(1)
    rows = [(g, *map(float, rng.normal(size=4))) for g in range(3) for _ in range(12)] + [(9, 1.0, 2.0, 3.0, 4.0), (8, 1.0, 1.0, 1.0, 1.0), (8, 2.0, 2.0, 2.0, 2.0), (8, 3.0, 3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double, u double, v double")
    got = {r["g"]: r for r in fits.fit_affine(df, ["g"], ("x", "y"), ["u", "v"]).collect()}
    loo = fits.loo_errors(df, ["g"], ("x", "y"), ["u", "v"]).collect()
    for g in range(3):
        part = np.array([r[1:] for r in rows if r[0] == g])
        a = np.column_stack([part[:, :2], np.ones(len(part))])
        want = np.linalg.lstsq(a, part[:, 2:], rcond=None)[0]
        assert np.allclose([[got[g]["u_x"], got[g]["v_x"]], [got[g]["u_y"], got[g]["v_y"]], [got[g]["u_0"], got[g]["v_0"]]], want)
        for i in range(len(part)):
            rest = np.delete(np.arange(len(part)), i)
            fit = np.linalg.lstsq(a[rest], part[rest, 2:], rcond=None)[0]
            error = np.linalg.norm(part[i, 2:] - a[i] @ fit)
            assert any(abs(r["loo"] - error) < 1e-9 for r in loo if r["g"] == g)
    assert got[9]["u_x"] is None and got[8]["u_x"] is None  # one point, and points on a line
    assert fits.fit_affine(df.limit(0), ["g"], ("x", "y"), ["u"]).count() == 0


def test_chains_invert_and_refuse_flat_steps(spark):
    step = [2, 1, 0, 3, 0, 1, 4, -1, 1, 0, 1, 7]
    points = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 0.0, 0.0)], "x double, y double, z double")
    back = fits.apply_chain(fits.apply_chain(points, [{"matrix": step, "error": 3.0}]), [{"matrix": step, "inverted": True, "error": 4.0}])
    got = back.collect()[0]
    assert np.allclose([got["x"], got["y"], got["z"]], [1, 2, 3]) and got["chain_error"] == 4.0
    with pytest.raises(ValueError):
        fits.fold_chain([{"matrix": [0] * 12, "inverted": True}])


def test_t_quantiles_and_intervals(spark):
    for df, want in ((1, 12.706205), (2, 4.302653), (5, 2.570582), (30, 2.042272), (200, 1.971896)):
        assert abs(fits.t_quantile(0.975, df) - want) < 1e-5
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0), ("c", None)], "g string, x double")
    got = {r["g"]: r for r in fits.t_interval(df, ["g"], "x").collect()}
    assert abs(got["a"]["high"] - got["a"]["mean"] - 4.302653 * np.std([1, 2, 4], ddof=1) / 3**0.5) < 1e-4
    assert got["b"]["low"] is None and got["c"]["n"] == 0
    many = fits.t_interval(spark.range(500).select(F.lit(1).alias("g"), (F.col("id") % 7).cast("double").alias("x")), ["g"], "x").first()
    assert abs((many["high"] - many["mean"]) / (np.std([i % 7 for i in range(500)], ddof=1) / 500**0.5) - 1.964729) < 1e-5


def test_exact_flips_and_permutations(spark):
    values = [0.3, -0.1, 0.5, 0.2, 0.25]
    got = fits.sign_flip_exact(spark.createDataFrame([(v,) for v in values], "d double"), "d").first()
    means = [np.mean([s * v for s, v in zip(signs, values, strict=True)]) for signs in itertools.product((1, -1), repeat=5)]
    assert got["patterns"] == 32 and abs(got["p"] - np.mean([abs(m) >= abs(np.mean(values)) - 1e-12 for m in means])) < 1e-12
    with pytest.raises(ValueError):
        fits.sign_flip_exact(spark.range(13).select(F.col("id").cast("double").alias("d")), "d")
    rows = [(i, float(i % 10), int(i % 3 == 0)) for i in range(300)]
    gaps = fits.permuted_gap(spark.createDataFrame(rows, "k long, s double, l int"), F.col("k"), "s", "l", 30, lambda k, d: rs.draw(k, d, 5))
    p = fits.permutation_p(gaps).first()
    want = np.mean([r[1] for r in rows if r[2]]) - np.mean([r[1] for r in rows if not r[2]])
    assert abs(p["observed"] - want) < 1e-9 and p["draws"] == 30 and 0.05 < p["p"] <= 1


def test_main_direction_like_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) * [5, 1, 1, 1, 1, 1]
    got = dict(vectors.main_direction(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, v array<double>"), "k", "v").collect())
    first = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0]
    along = x @ (first if first.sum() >= 0 else -first)
    assert np.allclose([got[i] for i in range(200)], along)


def test_platt_scale_is_the_optimum(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=400)
    label = (rng.random(400) < 1 / (1 + np.exp(-(2 * z - 0.5)))).astype(int)
    a, b = vectors.platt_fit(spark.createDataFrame([(float(s), int(k)) for s, k in zip(z, label, strict=True)], "z double, l int"), "z", "l")
    n = label.sum()
    target = np.where(label == 1, (n + 1) / (n + 2), 1 / (400 - n + 2))
    p = 1 / (1 + np.exp(-(a * z + b)))
    assert abs(((p - target) * z).sum()) < 1e-6 and abs((p - target).sum()) < 1e-6 and 1.2 < a < 3


def test_ridge_head_predicts_other_folds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0]
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    got = vectors.ridge_out_of_fold(spark.createDataFrame(rows, "k long, v array<double>, y double"), "k", "v", "y").collect()
    assert len(got) == 300 and len({r["fold"] for r in got}) == 3
    assert np.corrcoef([r["predicted"] for r in got], [y[r["k"]] for r in got])[0, 1] > 0.95


def test_similar_pairs_within_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5))
    rows = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)] + [(60, 0, [0.0] * 5)]
    got = {(r["a"], r["b"]) for r in vectors.sim_pairs(spark.createDataFrame(rows, "k long, g int, v array<double>"), "k", "g", "v", 0.4, blocks=4).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert got == {(a, b) for a, b in itertools.combinations(range(60), 2) if a % 3 == b % 3 and round(float(unit[a] @ unit[b]), 6) >= 0.4}


def test_box_pairs_of_all_extents(spark):
    rng = random.Random(6)
    boxes = []
    for i in range(150):
        low = [rng.uniform(-100, 100) for _ in range(2)]
        extent = rng.choice([0.0, 0.5, 3.0, 40.0, 1e5])
        boxes.append((i, *low, *[v + extent * rng.random() for v in low]))
    df = spark.createDataFrame(boxes, "id long, bmin_x double, bmin_y double, bmax_x double, bmax_y double")
    got = [(r["a"], r["b"]) for r in sp.box_pairs(df, ["x", "y"], 2.0).collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(boxes, 2) if all(a[k] <= b[k + 2] and b[k] <= a[k + 2] for k in (1, 2))}
    assert len(got) == len(set(got)) and set(got) == want


def test_asof_across_empty_cells(spark):
    line = [(0.5, 1.0), (1.5, 2.0), (57.0, 9.0), (57.5, 3.0), (130.0, 4.0)]
    points = spark.createDataFrame([(float(z),) for z in (-1, 0.5, 1.0, 30.0, 57.2, 100.0, 130.0, 500.0)], "z double")
    got = {r["z"]: r["v"] for r in sp.asof_interp(points, spark.createDataFrame(line, "z double, v double"), "z", "v", 10.0).collect()}
    want = np.interp(sorted(got), [z for z, _ in line], [v for _, v in line])
    assert np.allclose([got[z] for z in sorted(got)], want)


def test_largest_square_by_brute_force(spark):
    rng = random.Random(7)
    cells = [(m, y, x) for m, share in ((0, 0.7), (1, 0.95), (2, 1.0)) for y in range(17) for x in range(13) if rng.random() < share]
    got = {r["map_id"]: (r["side"], r["squares"]) for r in gr.largest_square(spark.createDataFrame(cells, "map_id int, y int, x int")).collect()}
    for m in range(3):
        full = {(y, x) for k, y, x in cells if k == m}
        fits_ = lambda s: sum(all((y + i, x + j) in full for i in range(s) for j in range(s)) for y, x in full)  # noqa: B023, E731
        side = max(s for s in range(1, 18) if fits_(s))
        assert got[m] == (side, fits_(side))


def test_triangles_that_touch_do_not_overlap(spark):
    tri = [(1, 0, 0, 0, 4, 0, 0, 4), (2, 0, 4, 0, 4, 4, 0, 4), (3, 0, 1, 1, 2, 1, 1, 2), (4, 1, 0, 0, 4, 0, 0, 4), (5, 0, 9, 9, 10, 10, 11, 11), (6, 0, 0, 4, 0, 0, 4, 0)]
    df = spark.createDataFrame(tri, "id long, sheet int, ax int, ay int, bx int, by int, cx int, cy int")
    assert {(r["a"], r["b"]) for r in meshes.triangle_overlaps(df, "sheet", 2.0).collect()} == {(1, 3), (1, 6), (3, 6)}
    got = {r["sheet"]: r for r in meshes.overlap_gate(df, "sheet", 2.0).collect()}
    assert (got[0]["flat"], got[0]["overlaps"], got[0]["witness_a"], got[0]["verdict"]) == (1, 3, 1, "overlap") and got[1]["verdict"] == "clear"


def test_cuts_and_hits_of_a_cone(spark):
    # a cone of radius z about the origin, as triangles
    ring = lambda z: [(z * math.cos(a * math.pi / 20), z * math.sin(a * math.pi / 20), z) for a in range(41)]
    low, high = ring(1.0), ring(5.0)
    rows = [(0, *a, *b, *c) for i in range(40) for a, b, c in ((low[i], high[i], low[i + 1]), (high[i], high[i + 1], low[i + 1]))]
    tri = spark.createDataFrame([tuple(map(float, r)) for r in rows], "m double, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    hits = meshes.ray_hits(meshes.plane_cut(tri, 2.0, 1.0), 24, 0.003).groupBy("plane", "ray").agg(F.min("radius").alias("low"), F.max("radius").alias("high")).collect()
    assert len(hits) == 24 * 3 or len(hits) == 24 * 4
    assert all(abs(r["high"] - (2 + r["plane"])) < 0.02 * (2 + r["plane"]) and r["high"] - r["low"] < 1e-6 for r in hits)


def test_lines_of_boxes(spark):
    boxes = [("i", 1, 0, 10, 0, 10), ("i", 2, 12, 20, 1, 11), ("i", 3, 60, 70, 0, 10), ("i", 4, 0, 10, 30, 40), ("i", 5, 2, 12, 31, 41), ("i", 5, 2, 12, 31, 41)]
    got = {r["id"]: (r["line"], r["place"], r["ambiguous"]) for r in meshes.group_lines(spark.createDataFrame(boxes, "img string, id long, x0 int, x1 int, y0 int, y1 int"), "img").collect()}
    assert got == {1: (1, 1, False), 2: (1, 2, False), 3: (3, 1, False), 4: (4, 1, True), 5: (4, 2, True)}


def clip_area(a, b):
    """The shared area of two triangles by clipping in exact numbers."""
    from fractions import Fraction

    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    a, b = ([tuple(map(Fraction, p)) for p in t] for t in (a, b))
    a, b = (t if cross(*t) > 0 else [t[0], t[2], t[1]] for t in (a, b))
    for i in range(3):
        p, q, out = b[i], b[(i + 1) % 3], []
        for last, now in zip([a[-1], *a[:-1]] if a else [], a, strict=True):
            x, y = cross(p, q, last), cross(p, q, now)
            if (x >= 0) != (y >= 0):
                out.append((last[0] + x / (x - y) * (now[0] - last[0]), last[1] + x / (x - y) * (now[1] - last[1])))
            if y >= 0:
                out.append(now)
        a = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, a[1:] + a[:1], strict=True))) / 2 if a else Fraction(0)


def test_shared_areas_like_exact_clipping(spark):
    rng = random.Random(11)
    tri = {i: (i % 2, [(rng.randrange(12), rng.randrange(12)) for _ in range(3)]) for i in range(60)}
    schema = "id long, sheet int, ax int, ay int, bx int, by int, cx int, cy int, area int, shared double"
    df = spark.createDataFrame([(i, s, *t[0], *t[1], *t[2], 1, 0.0) for i, (s, t) in tri.items()] + [(99, 0, 1, 1, 2, 2, 3, 3, 1, 0.0), (98, 0, None, 1, 2, 2, 3, 9, 1, 0.0)], schema)
    flat = lambda t: (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) == (t[1][1] - t[0][1]) * (t[2][0] - t[0][0])
    areas = {(i, j): clip_area(tri[i][1], tri[j][1]) for i in tri for j in tri if i < j and tri[i][0] == tri[j][0] and not flat(tri[i][1]) and not flat(tri[j][1])}
    assert {(r["a"], r["b"]) for r in meshes.triangle_overlaps(df, "sheet", 4.0).collect()} == {k for k, x in areas.items() if x > 0}
    for eps in (0.1234, 2.0):
        got = {(r["a"], r["b"]): r["shared"] for r in meshes.triangle_overlaps(df, "sheet", 4.0, eps).collect()}
        assert got == {k: pytest.approx(float(x)) for k, x in areas.items() if x > eps} and got
    sheets = spark.createDataFrame([(0, 100.0), (1, 1.0), (2, 5.0), (3, 0.0)], "sheet int, source_area double")
    got = {r["sheet"]: r for r in meshes.sheet_verdict(df, sheets, "sheet", 4.0, 1e6).collect()}
    total = sum(abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0])) / 2 for s, t in tri.values() if s == 0)
    assert got[0]["coverage"] == pytest.approx(total / 100) and got[1]["passed"] and (got[2]["verdict"], got[2]["coverage"], got[2]["passed"]) == ("empty", 0.0, False) and got[3]["coverage"] is None and not got[3]["passed"]
    assert meshes.overlap_gate(df.limit(0), "sheet", 4.0, 1.0).count() == 0
