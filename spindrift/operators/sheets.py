"""Meshes as a graph: orientation and positions, components of linked points with their holes, sure pieces and ladders.

Iterations are rounds of joins and sums whose state is written to the shared folder; the driver sees a few sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, written


def _both(pairs: DataFrame, sign: str | None = None) -> DataFrame:
    """The pairs in both directions; column ``sign`` changes its sign on the way back."""
    back = {"a": F.col("b"), "b": F.col("a")} | ({sign: -F.col(sign)} if sign else {})
    return pairs.unionByName(pairs.select(*[back.get(c, F.col(c)).alias(c) for c in pairs.columns]))


def forest(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, root, level, sign: breadth-first from the largest node of each component (ties: the smallest number).

    nodes: node, area. pairs: a, b, matched, orient (1 or -1). A node hangs on the node of the level before with which most
    is matched (ties: the smallest number, then 1 before -1). Nulls and pairs of a node with itself are left out; nodes
    without pairs are roots.
    """
    nodes = nodes.where("node is not null").groupBy("node").agg(F.max("area").alias("area"))
    links = pairs.where("a <> b and orient is not null and matched is not null").select("a", "b", "matched", "orient")
    links = written(_both(links).join(nodes.select(F.col("node").alias("a")), "a").join(nodes.select(F.col("node").alias("b")), "b"), "links")
    parts = components(nodes.select("node"), links.select("a", "b")).join(nodes, "node")
    first = F.struct(F.coalesce("area", F.lit(float("-inf"))).alias("area"), (-F.col("node")).alias("k"))
    roots = parts.groupBy("component").agg((-F.max(first)["k"]).alias("root"))
    out = written(roots.select(F.col("root").alias("node"), "root", F.lit(0).alias("level"), F.lit(1).alias("sign")), "forest")
    front, level = out, 0
    while front.limit(1).count():
        level += 1
        said = links.join(front.select(F.col("node").alias("a"), "root", "sign"), "a").join(out.select(F.col("node").alias("b")), "b", "left_anti")
        best = F.max(F.struct("matched", (-F.col("a")).alias("k"), "orient", "sign", "root")).alias("best")
        front = written(said.groupBy("b").agg(best).select(F.col("b").alias("node"), "best.root", F.lit(level).alias("level"), (F.col("best.sign") * F.col("best.orient")).alias("sign")), "forest")
        out = out.unionByName(front)
    return out


def orient_meshes(nodes: DataFrame, pairs: DataFrame, min_matched: float = 0) -> tuple[DataFrame, DataFrame]:
    """(node, root, level, sign; a row for each root: nodes, conflicts, the pairs whose orientation the signs contradict).

    nodes: node, area, outward (how far its normals point outward on average, null counts as 0). Signs spread by
    :func:`forest` over pairs with ``min_matched`` or more; all of them are turned if together they point inward.
    """
    used = pairs.where(F.col("matched") >= min_matched).select("a", "b", "matched", "orient")
    found = written(forest(nodes, used), "signs")
    vote = found.join(nodes.groupBy("node").agg(F.max("outward").alias("outward")), "node").agg(F.sum(F.col("sign") * F.coalesce("outward", F.lit(0.0))).alias("v")).first()["v"]
    turn = -1 if vote is not None and vote < 0 else 1
    signs = found.withColumn("sign", (F.col("sign") * turn).cast("int"))
    side = lambda k: found.select(F.col("node").alias(k), F.col("sign").alias(f"sign_{k}"), F.col("root").alias(f"root_{k}"))
    bad = used.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("sign_a * sign_b <> orient").groupBy(F.col("root_a").alias("root")).agg(F.count("*").alias("conflicts"))
    counts = found.groupBy("root").agg(F.count("*").alias("nodes")).join(bad, "root", "left")
    return signs, counts.select("root", "nodes", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def mesh_positions(pairs: DataFrame, signs: DataFrame, min_matched: float = 0, reach: float = float("inf"), tolerance: float = 1e-10, rounds: int = 500) -> DataFrame:
    """node, component (its smallest node, whose position is 0), position: weighted least squares of the pairs' offsets.

    pairs: a, b, matched, offset. Each asks that position(a) - position(b) be sign(b) * offset, with weight matched. The
    normal equations are solved by conjugate gradients for all components at once: a round is a join and two sums. Pairs
    beyond ``reach``, without an offset or of one node are left out, and nodes without a pair have no row.
    """
    ok = (F.col("matched") >= min_matched) & (F.col("matched") > 0) & F.col("offset").isNotNull() & (F.abs("offset") <= reach) & (F.col("a") != F.col("b"))
    turned = pairs.where(ok).select("a", "b", "matched", "offset").join(signs.select(F.col("node").alias("b"), "sign"), "b").join(signs.select(F.col("node").alias("a")), "a", "left_semi")
    links = written(turned.groupBy("a", "b").agg(F.sum("matched").cast("double").alias("w"), F.sum(F.col("matched") * F.col("sign") * F.col("offset")).cast("double").alias("wo")), "equations")
    links = written(_both(links, "wo").groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("wo").alias("wo")), "equations")
    parts = components(links.select(F.col("a").alias("node")).distinct(), links.select("a", "b"))
    # r: what is left of the right side; p: direction; both divided by the diagonal d where it says so
    right = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"), F.sum("wo").alias("r"))
    state = written(right.select("node", "d", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("d")).alias("p")), "gradients")
    rz = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
    least = rz * tolerance**2
    for _ in range(rounds):
        if rz <= least:
            break
        pulled = links.join(state.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("w") * F.col("pb")).alias("s"))
        moved = written(state.join(pulled, "node").withColumn("ap", F.col("d") * F.col("p") - F.col("s")), "gradients")
        alpha = rz / (moved.agg(F.sum(F.col("p") * F.col("ap"))).first()[0] or float("inf"))
        moved = moved.select("node", "d", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        now = moved.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]
        state = written(moved.withColumn("p", F.col("r") / F.col("d") + now / rz * F.col("p")), "gradients")
        rz = now
    placed = state.join(parts, "node")
    anchor = placed.where("node = component").select("component", F.col("x").alias("x0"))
    return placed.join(anchor, "component").select("node", "component", (F.col("x") - F.col("x0")).alias("position"))


def duplicate_groups(nodes: DataFrame, pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """node, kept: meshes chained by pairs whose coverage reaches ``share``, and the one that stays, the largest (ties: the smallest number).

    nodes: node, area. pairs: a, b, coverage. Groups of one are left out.
    """
    close = pairs.where((F.col("coverage") >= share) & (F.col("a") != F.col("b"))).select("a", "b")
    members = components(_both(close).select(F.col("a").alias("node")).distinct(), close).join(nodes.select("node", "area"), "node")
    best = members.groupBy("component").agg((-F.max(F.struct(F.coalesce("area", F.lit(float("-inf"))).alias("area"), (-F.col("node")).alias("k")))["k"]).alias("kept"))
    return members.join(best, "component").select("node", "kept")


_STEPS = ((0, 1), (1, 0), (1, 1), (1, -1))


def _beside(points: DataFrame, steps, columns: list[str]) -> DataFrame:
    """Each point beside those at the given steps, whose columns are prefixed with n_."""
    moved = points.withColumn("_to", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in steps])))
    other = points.select("sheet", F.col("r").alias("_r"), F.col("c").alias("_c"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return moved.join(other.withColumnRenamed("sheet", "_s"), (F.col("sheet") == F.col("_s")) & (F.col("_to.r") == F.col("_r")) & (F.col("_to.c") == F.col("_c")))


def linked_components(points: DataFrame, link: float, hole: int = 0) -> DataFrame:
    """sheet, r, c, id, component, filled: 8-neighbours of a sheet's grid join where their offset centres lie close along the mean normal.

    points: id (distinct), sheet, r, c, x, y, z, nx, ny, nz (unit normals) and off, the offset along the normal (null or NaN:
    the point counts nowhere). Centres are placed in space; their difference along the summed normals may be ``link`` at
    most, and normals that nearly cancel do not join. A hole, 4-connected cells without a component that do not reach the
    sheet's edge, of up to ``hole`` cells joins the component that is all of its rim (filled; id is then null). A component
    is named by its smallest id. Rows that repeat a cell are taken once.
    """
    p = points.where("off is not null and not isnan(off)").dropDuplicates(["sheet", "r", "c"])
    centre = [(F.col(a) + F.col("off") * F.col(f"n{a}")).alias(f"c{a}") for a in "xyz"]
    p = written(p.select("id", "sheet", "r", "c", *centre, "nx", "ny", "nz"), "points")
    near = _beside(p, _STEPS, ["id", *[f"c{a}" for a in "xyz"], *[f"n{a}" for a in "xyz"]])
    along = sum((((F.col(f"c{a}") - F.col(f"n_c{a}")) * (F.col(f"n{a}") + F.col(f"n_n{a}"))) for a in "xyz"), F.lit(0.0))
    size = F.sqrt(sum((F.pow(F.col(f"n{a}") + F.col(f"n_n{a}"), F.lit(2)) for a in "xyz"), F.lit(0.0)))
    links = near.where((size > 1) & (F.abs(along) <= link * size)).select(F.col("id").alias("a"), F.col("n_id").alias("b"), "sheet")
    named = written(components(p.select(F.col("id").alias("node")), links, "sheet").select(F.col("node").alias("id"), "component").join(p.select("id", "sheet", "r", "c"), "id"), "linked")
    out = named.select("sheet", "r", "c", "id", "component", F.lit(False).alias("filled"))
    if not hole:
        return out
    # cells of a sheet's extent that have no component; their own numbers are places in the extent
    box = points.groupBy("sheet").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    cells = box.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("c", F.explode(F.sequence("c0", "c1")))
    edge = (F.col("r") == F.col("r0")) | (F.col("r") == F.col("r1")) | (F.col("c") == F.col("c0")) | (F.col("c") == F.col("c1"))
    empty = cells.join(named.select("sheet", "r", "c"), ["sheet", "r", "c"], "left_anti").select("sheet", "r", "c", edge.alias("edge"))
    empty = written(empty.withColumn("id", F.monotonically_increasing_id()), "empty")
    touching = _beside(empty, ((0, 1), (1, 0)), ["id"]).select(F.col("id").alias("a"), F.col("n_id").alias("b"), "sheet")
    holes = components(empty.select(F.col("id").alias("node")), touching, "sheet").select(F.col("node").alias("id"), F.col("component").alias("gap"))
    holes = written(holes.join(empty, "id"), "holes")
    small = holes.groupBy("gap").agg(F.count("*").alias("n"), F.bool_or("edge").alias("edge")).where((F.col("n") <= hole) & ~F.col("edge")).select("gap")
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    open_ = holes.join(small, "gap").select("gap", "sheet", "r", "c")
    rim = open_.select("gap", "sheet", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in around])).alias("to"))
    rim = rim.select("gap", "sheet", "to.r", "to.c").join(open_, ["gap", "sheet", "r", "c"], "left_anti").distinct()
    one = rim.join(named.select("sheet", "r", "c", "component"), ["sheet", "r", "c"], "left").groupBy("gap").agg(F.min("component").alias("component"), F.max("component").alias("last"), F.count_if(F.col("component").isNull()).alias("open"))
    filled = open_.join(one.where("component = last and open = 0").select("gap", "component"), "gap")
    return out.unionByName(filled.select("sheet", "r", "c", F.lit(None).cast("long").alias("id"), "component", F.lit(True).alias("filled")))


def bridges(labelled: DataFrame, far: float, least: int = 1) -> DataFrame:
    """component, on_a, on_b of components that hold ``least`` points or more clearly on each of two sheets.

    labelled: component, weight (0: on sheet a, 1: on sheet b, between: on the way) and apart, the distance of the two sheets
    there (null: not clear); a point is clear if they are more than ``far`` apart.
    """
    clear = labelled.where((F.abs("apart") > far) & F.col("component").isNotNull())
    n = clear.groupBy("component").agg(F.count_if(F.col("weight") <= 0).alias("on_a"), F.count_if(F.col("weight") >= 1).alias("on_b"))
    return n.where((F.col("on_a") >= least) & (F.col("on_b") >= least))


def sure_pieces(pieces: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """piece, slice, component, label, bad, distance, sure, main.

    pieces: piece, slice, label (null: none), component (labels of two components share no offset). edges: a, b, step: the
    labels are to differ by step. A piece is bad if an edge at it is violated, that is both labels are there and do not differ
    so, or one is missing. distance counts edges to the nearest bad piece, by ``least`` - 1 rounds from all of them at once; it
    is null from ``least`` on, and there a labelled piece is sure. The main component of a slice has the most sure pieces
    (ties: the smallest number).
    """
    once = pieces.where("piece is not null").dropDuplicates(["piece"]).select("piece", "slice", "component", "label")
    labels = once.select("piece", "label")
    e = edges.join(labels.select(F.col("piece").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("piece").alias("b"), F.col("label").alias("lb")), "b")
    e = written(e.select("a", "b", F.coalesce(F.col("lb") - F.col("la") != F.col("step"), F.lit(True)).alias("wrong")), "piece-edges")
    links = written(_both(e.select("a", "b")).where("a <> b").distinct(), "piece-links")
    bad = e.where("wrong").select(F.explode(F.array("a", "b")).alias("piece")).distinct()
    found = front = written(bad.withColumn("distance", F.lit(0)), "bad-pieces")
    for step in range(1, least):
        following = links.join(front.select(F.col("piece").alias("a")), "a").select(F.col("b").alias("piece")).distinct()
        front = written(following.join(found, "piece", "left_anti").withColumn("distance", F.lit(step)), "bad-pieces")
        found = found.unionByName(front)
    out = once.join(found, "piece", "left")
    out = out.withColumn("bad", F.coalesce(F.col("distance") == 0, F.lit(False))).withColumn("sure", F.col("label").isNotNull() & ~F.isnan(F.col("label").cast("double")) & F.col("distance").isNull())
    most = out.where("sure").groupBy("slice", "component").agg(F.count("*").alias("n"))
    main = most.groupBy("slice").agg((-F.max(F.struct("n", (-F.col("component")).alias("k")))["k"]).alias("_main"))
    out = out.join(main, "slice", "left")
    return out.select("piece", "slice", "component", "label", "bad", "distance", "sure", F.coalesce(F.col("sure") & (F.col("component") == F.col("_main")), F.lit(False)).alias("main"))


def ladder_points(pixels: DataFrame, pieces: DataFrame, k: int = 8) -> DataFrame:
    """slice, piece, theta, radius, wind, level, wind_plus_one: up to k points of each main piece, spread evenly along it.

    pixels: piece, theta, radius, ordered by both along a piece. wind is the label above the slice's lowest main label, level
    the number of its distinct value, and wind_plus_one the control in which every step between levels gains one turn. The
    places are i * (n - 1) / (k - 1) of a piece's n, rounded half to even; all of them if n is k or less. k is 2 or more.
    """
    main = pieces.where("main").select("piece", "slice", "label")
    low = main.groupBy("slice").agg(F.min("label").alias("_low"))
    levels = main.select("slice", "label").distinct().withColumn("level", F.row_number().over(Window.partitionBy("slice").orderBy("label")) - 1)  # the labels of one slice
    named = written(main.join(low, "slice").join(levels, ["slice", "label"]).select("piece", "slice", (F.col("label") - F.col("_low")).alias("wind"), "level"), "ladder-pieces")
    mine = pixels.join(named, "piece")
    n = mine.groupBy("piece").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("piece").orderBy("theta", "radius")) - 1  # the pixels of one piece
    at = mine.withColumn("_i", place).join(n, "piece")
    # places lie more than one apart, so only the nearest i can give this one
    share = (F.col("_n") - 1) / F.lit(float(k - 1))
    picked = (F.col("_n") <= k) | (F.bround(F.round(F.col("_i") / share) * share) == F.col("_i"))
    return at.where(picked).select("slice", "piece", "theta", "radius", "wind", "level", (F.col("wind") + F.col("level")).alias("wind_plus_one"))


def ladder_report(pieces: DataFrame, points: DataFrame) -> DataFrame:
    """By slice: pieces, bad, sure, written, left_out, components with a sure piece, points, levels, span and the widest step of theta."""
    a = pieces.groupBy("slice").agg(F.count("*").alias("pieces"), F.count_if("bad").alias("bad"), F.count_if("sure").alias("sure"), F.count_if("main").alias("written"), F.count_distinct(F.when(F.col("sure"), F.col("component"))).alias("components"))
    step = F.col("theta") - F.lag("theta").over(Window.partitionBy("slice").orderBy("theta"))  # the k points of each piece of one slice
    b = points.withColumn("_gap", step).groupBy("slice").agg(F.count("*").alias("points"), F.count_distinct("wind").alias("levels"), (F.max("wind") - F.min("wind")).alias("span"), F.max("_gap").alias("max_gap"))
    out = a.join(b, "slice", "left").withColumn("left_out", F.col("sure") - F.col("written"))
    return out.select("slice", "pieces", "bad", "sure", "written", "left_out", "components", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("points", "levels")], "span", F.coalesce("max_gap", F.lit(0.0)).alias("max_gap"))

