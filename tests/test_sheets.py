"""Meshes as graphs against plain loops: orientation, positions, linked components, bridges, sure pieces and ladders."""

import random
from collections import Counter, deque

import numpy as np
import pytest

from spindrift.operators import sheets

NODES, PAIRS = "node long, area double, outward double, root int", "a long, b long, matched long, orient int, offset double, coverage double, sign int"


def random_meshes(seed, n=40, m=70):
    rng = random.Random(seed)
    hidden = [rng.choice([1, -1]) for _ in range(n)]
    nodes = [(i, float(rng.randrange(1, 9)), -0.5 * hidden[i] + rng.uniform(-0.1, 0.1), 7) for i in range(n)]
    pairs = {}
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        if a % 3 == b % 3:
            pairs[a, b] = (a, b, rng.randrange(1, 30), hidden[a] * hidden[b] * (-1 if rng.random() < 0.2 else 1), rng.uniform(-3, 3), rng.random(), 1)
    return nodes, list(pairs.values())


def breadth_first(nodes, pairs):
    area, near, out = {r[0]: r[1] for r in nodes}, {}, {}
    for a, b, matched, orient, *_ in pairs:
        near.setdefault(a, []).append((matched, b, orient))
        near.setdefault(b, []).append((matched, a, orient))
    for root in sorted(area, key=lambda x: (-area[x], x)):
        if root in out:
            continue
        out[root], front, level = (root, 0, 1), [root], 0
        while front:
            level += 1
            reached = {y for x in front for _, y, _ in near.get(x, []) if y not in out}
            for y in reached:
                _, k, orient = max((m, -x, o) for m, x, o in near[y] if x in front)
                out[y] = (root, level, out[-k][2] * orient)
            front = list(reached)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_signs_and_positions_like_loops(spark, seed):
    nodes, pairs = random_meshes(seed)
    signs, counts = sheets.orient_meshes(spark.createDataFrame(nodes, NODES), spark.createDataFrame(pairs, PAIRS))
    got = {r["node"]: (r["root"], r["level"], r["sign"]) for r in signs.collect()}
    want = breadth_first(nodes, pairs)
    turn = -1 if sum(want[i][2] * v for i, _, v, _ in nodes) < 0 else 1
    want = {k: (r, x, s * turn) for k, (r, x, s) in want.items()}
    assert got == want
    bad = Counter(want[a][0] for a, b, _, o, *_ in pairs if want[a][2] * want[b][2] != o)
    assert {r["root"]: (r["nodes"], r["conflicts"]) for r in counts.collect()} == {root: (n, bad[root]) for root, n in Counter(r for r, *_ in want.values()).items()}
    places = {r["node"]: (r["component"], r["position"]) for r in sheets.mesh_positions(spark.createDataFrame(pairs, PAIRS), signs, min_matched=4, reach=2.5).collect()}
    used = [p for p in pairs if p[2] >= 4 and abs(p[4]) <= 2.5]
    linked = breadth_first([(i, -float(i), 0, 0) for i in range(len(nodes))], used)
    members = {}
    for i, (root, *_) in linked.items():
        members.setdefault(root, []).append(i)
    for root, group in members.items():
        if len(group) == 1:
            assert root not in places
            continue
        col, rows, right = {g: k for k, g in enumerate(sorted(group))}, [], []
        for a, b, matched, _, offset, *_ in used:
            if a in col:
                row = np.zeros(len(col))
                row[col[a]], row[col[b]] = matched**0.5, -(matched**0.5)
                rows.append(row)
                right.append(matched**0.5 * want[b][2] * offset)
        rows.append(np.eye(len(col))[0])
        right.append(0.0)
        x = np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0]
        assert all(places[g] == (root, pytest.approx(x[k], abs=1e-7)) for g, k in col.items())


def test_meshes_of_odd_rows(spark):
    none, nothing = spark.createDataFrame([], NODES), spark.createDataFrame([], PAIRS)
    signs, counts = sheets.orient_meshes(none, nothing)
    assert signs.count() == 0 and counts.count() == 0 and sheets.mesh_positions(nothing, signs).count() == 0 and sheets.duplicate_groups(none, nothing).count() == 0
    nodes = spark.createDataFrame([(1, 2.0, None, 1), (1, 2.0, None, 1), (2, None, 0.3, 1), (None, 9.0, 1.0, 1), (3, 2.0, 0.0, 1)], NODES)
    pairs = spark.createDataFrame([(1, 1, 5, -1, 1.0, 0.9, 1), (1, 2, 5, -1, None, 0.9, 1), (2, 1, 5, None, 1.0, None, 1), (None, 2, 5, 1, 1.0, 0.9, 1), (2, 99, 9, 1, 1.0, 0.9, 1)], PAIRS)
    signs, counts = sheets.orient_meshes(nodes, pairs)
    assert {(r["node"], r["root"], r["sign"]) for r in signs.collect()} == {(1, 1, -1), (2, 1, 1), (3, 3, -1)} and sum(r["conflicts"] for r in counts.collect()) == 0
    # only 2 -> 1 has an offset between known meshes: position(2) - position(1) = sign(1) * 1
    assert {r["node"]: r["position"] for r in sheets.mesh_positions(pairs, signs).collect()} == {1: 0.0, 2: pytest.approx(-1.0)}
    assert {(r["node"], r["kept"]) for r in sheets.duplicate_groups(nodes.where("node is not null").distinct(), pairs).collect()} == {(1, 1), (2, 1)}


POINTS = "id long, sheet int, r int, c int, x double, y double, z double, nx double, ny double, nz double, off double, component int"


def random_points(seed, h=14, w=17):
    rng = np.random.default_rng(seed)
    out = []
    for sheet in range(2):
        for r in range(h):
            for c in range(w):
                if rng.random() < 0.06:
                    continue
                n = rng.normal(size=3) * 0.2 + np.array([0, 0, 1.0 if rng.random() < 0.97 else -1.0])
                n /= np.linalg.norm(n)
                off = None if rng.random() < 0.18 else float(rng.choice([0.0, 0.4, 0.9])) + (4.0 if c > 8 + r % 3 else 0.0)
                out.append((sheet * 1000 + r * w + c, sheet, r, c, float(c), float(r), float(0.1 * c), *map(float, n), off, 1))
    return out


def plain_components(points, link, hole):
    at = {(s, r, c): (i, np.array([x, y, z]) + off * np.array([a, b, d]), np.array([a, b, d])) for i, s, r, c, x, y, z, a, b, d, off, _ in points if off is not None}
    near, label = {}, {}
    for (s, r, c), (i, p, n) in at.items():
        for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
            if (s, r + dr, c + dc) in at:
                j, q, m = at[s, r + dr, c + dc]
                size = np.linalg.norm(n + m)
                if size > 1 and abs((p - q) @ (n + m)) <= link * size:
                    near.setdefault(i, []).append(j)
                    near.setdefault(j, []).append(i)
    for i in sorted(v[0] for v in at.values()):
        if i not in label:
            queue, label[i] = deque([i]), i
            while queue:
                for j in near.get(queue.popleft(), []):
                    if j not in label:
                        label[j] = i
                        queue.append(j)
    out = {(s, r, c): (label[v[0]], False) for (s, r, c), v in at.items()}
    for sheet in {p[1] for p in points}:
        rows, cols = ([p[k] for p in points if p[1] == sheet] for k in (2, 3))
        low, high, left, right = min(rows), max(rows), min(cols), max(cols)
        seen = set()
        for r in range(low, high + 1):
            for c in range(left, right + 1):
                if (sheet, r, c) in at or (r, c) in seen:
                    continue
                gap, queue = {(r, c)}, deque([(r, c)])
                while queue:
                    y, x = queue.popleft()
                    for t in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if low <= t[0] <= high and left <= t[1] <= right and (sheet, *t) not in at and t not in gap:
                            gap.add(t)
                            queue.append(t)
                seen |= gap
                rim = {(y + a, x + b) for y, x in gap for a in (-1, 0, 1) for b in (-1, 0, 1)} - gap
                names = {label[at[sheet, *t][0]] if (sheet, *t) in at else None for t in rim}
                if len(gap) <= hole and not any(y in (low, high) or x in (left, right) for y, x in gap) and len(names) == 1 and None not in names:
                    out |= {(sheet, *t): (*names, True) for t in gap}
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_linked_components_like_a_walk(spark, seed):
    points = random_points(seed)
    got = sheets.linked_components(spark.createDataFrame(points + points[:5], POINTS), 0.8, 4)
    got = {(r["sheet"], r["r"], r["c"]): (r["component"], r["filled"]) for r in got.collect()}
    assert got == plain_components(points, 0.8, 4) and any(f for _, f in got.values())
    assert sheets.linked_components(spark.createDataFrame([], POINTS), 1.0, 3).count() == 0


def test_bridges(spark):
    rows = [(1, 0.0, 9.0), (1, 1.0, -9.0), (1, 0.5, 9.0), (2, 0.0, 9.0), (2, 1.0, 2.0), (3, 1.0, None), (None, 0.0, 9.0), (None, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "component long, weight double, apart double")
    assert [tuple(r) for r in sheets.bridges(df, 6.0).collect()] == [(1, 1, 1)]
    assert sheets.bridges(df, 6.0, 2).count() == 0 and sheets.bridges(df.limit(0), 6.0).count() == 0


@pytest.mark.parametrize("least", [1, 3])
def test_sure_pieces_and_ladders_like_loops(spark, least):
    rng = random.Random(5)
    labels = {i: None if rng.random() < 0.05 else i % 60 // 6 + (rng.random() < 0.05) for i in range(240)}
    pieces = [(i, i // 60, i % 60 // 25, labels[i], 1) for i in range(240)]
    edges = [(i, i + d, (i + d) % 60 // 6 - i % 60 // 6) for i in range(240) for d in (1, 7) if (i + d) // 60 == i // 60]
    df = sheets.sure_pieces(spark.createDataFrame(pieces, "piece long, slice int, component int, label int, sure int"), spark.createDataFrame(edges, "a long, b long, step int"), least).cache()
    wrong = {x for a, b, s in edges for x in (a, b) if None in (labels[a], labels[b]) or labels[b] - labels[a] != s}
    distance, front = dict.fromkeys(wrong, 0), wrong
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for step in range(1, least):
        front = {y for x in front for y in near.get(x, ()) if y not in distance}
        distance |= dict.fromkeys(front, step)
    sure = {i for i in range(240) if i not in distance and labels[i] is not None}
    counts = Counter((i // 60, i % 60 // 25) for i in sure)
    main = {s: min((-n, c) for (t, c), n in counts.items() if t == s)[1] for s, _ in counts}
    got = {r["piece"]: (r["bad"], r["distance"], r["sure"], r["main"]) for r in df.collect()}
    assert got == {i: (i in wrong, distance.get(i), i in sure, i in sure and main[i // 60] == i % 60 // 25) for i in range(240)}
    pixels = [(i, rng.random(), float(j)) for i in range(240) for j in range(rng.randrange(30))]
    points = sheets.ladder_points(spark.createDataFrame(pixels, "piece long, theta double, radius double"), df, 5)
    kept, want = {i for i in got if got[i][3]}, []
    for i in kept:
        mine = sorted(p for p in pixels if p[0] == i)
        levels = sorted({labels[j] for j in kept if j // 60 == i // 60})
        for at in sorted(set(np.rint(np.linspace(0, len(mine) - 1, min(5, len(mine)))).astype(int))) if mine else []:
            wind, level = labels[i] - levels[0], levels.index(labels[i])
            want.append((i // 60, i, mine[at][1], mine[at][2], wind, level, wind + level))
    assert sorted(map(tuple, points.collect())) == sorted(want)
    for r in sheets.ladder_report(df, points).collect():
        mine = sorted(p for p in want if p[0] == r["slice"])
        assert (r["pieces"], r["sure"], r["points"], r["levels"]) == (60, sum(i // 60 == r["slice"] for i in sure), len(mine), len({p[4] for p in mine}))
        assert r["max_gap"] == pytest.approx(max(np.diff(sorted(p[2] for p in mine)), default=0.0))


def test_pieces_of_odd_rows(spark):
    pieces, edges = "piece long, slice int, component int, label double", "a long, b long, step int"
    empty = sheets.sure_pieces(spark.createDataFrame([], pieces), spark.createDataFrame([], edges))
    assert empty.count() == 0 and sheets.ladder_report(empty, sheets.ladder_points(spark.createDataFrame([], "piece long, theta double, radius double"), empty)).count() == 0
    rows = [(1, 0, 0, 1.0), (1, 0, 0, 1.0), (2, 0, 0, float("nan")), (3, 0, 1, None), (None, 0, 1, 2.0), (4, 0, 1, 5.0)]
    got = sheets.sure_pieces(spark.createDataFrame(rows, pieces), spark.createDataFrame([(1, 1, 0), (4, None, 1), (77, 1, 1)], edges))
    assert {(r["piece"], r["sure"], r["main"]) for r in got.collect()} == {(1, True, True), (2, False, False), (3, False, False), (4, True, False)}
