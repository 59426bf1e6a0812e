"""Exact density clustering (DBSCAN) on standardised features.

Points are first merged to distinct coordinates with a weight, then put in
cells so small that all points of a cell are neighbours. A cell holding
``min_points`` is dense: its points are core points and no pair inside it is
ever formed. The other cells hold fewer than ``min_points`` points each, so
comparing those with nearby cells costs a constant number of comparisons per
point. Whether two nearby cells touch is decided on bounding boxes that are
halved until every pair is settled.

Up to three features, nearby cells are enumerated. Beyond that their number
would grow with the power of the features, so pairs of cells are grown feature
by feature among the cells that exist, and a pair out of reach in the first
features is never grown. The cells next to each other are looked at first. That
settles most core points and joins most cells, and wider pairs are formed only
for points that are still undecided and between parts that are still apart.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import ref
from tablewright.operators.ordering import with_row_number

#: Features whose nearby cells are enumerated.
LISTED_FEATURES = 3
NOISE = -1


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cell offsets that can hold a neighbour, own cell included."""
    reach = math.isqrt(d - 1) + 1
    return [
        o
        for o in itertools.product(range(-reach, reach + 1), repeat=d)
        if sum(max(abs(i) - 1, 0) ** 2 for i in o) <= d
    ]


def _cell(names: Sequence[str], side: float) -> Column:
    return F.array(*[F.floor(ref(n) / F.lit(side)).cast("long") for n in names])


def _nearby(cell: Column, offsets: Sequence[tuple[int, ...]]) -> Column:
    """One row per offset cell."""
    return F.explode(
        F.array(
            *[
                F.array(*[cell[i] + F.lit(step).cast("long") for i, step in enumerate(o)])
                for o in offsets
            ]
        )
    )


def _near_cells(
    left: DataFrame, right: DataFrame, d: int, reach: int, apart: bool = False
) -> DataFrame:
    """(a, b): cells of ``left`` and of ``right`` that are close enough to hold neighbours.

    They are at most ``reach`` steps apart in each feature. Pairs grow by one
    feature at a time. With ``apart``, cells have a ``root``; only pairs with
    two different ones are formed, each once, and beginnings of cells that all
    have the same root are not grown.
    """
    pairs = None
    for k in range(d):
        sides = []
        for cells, name in ((left, "a"), (right, "b")):
            roots = [F.min("root").alias(f"{name}_lo"), F.max("root").alias(f"{name}_hi")] if apart else []
            begun = cells.groupBy(F.slice("cell", 1, k + 1).alias(name))
            sides.append(begun.agg(*roots) if apart else begun.agg(F.count(F.lit(1))).select(name))
        a, b = sides
        if pairs is None:
            grown = a.withColumns({"ahead": F.array().cast("array<bigint>"), "gap": F.lit(0)})
        else:
            up = pairs.select(F.col("a").alias("up"), F.col("b").alias("ahead"), "gap")
            grown = a.withColumn("up", F.slice("a", 1, k)).join(up, "up").drop("up")
        steps = F.explode(F.array(*[F.lit(i).cast("long") for i in range(-reach, reach + 1)]))
        beyond = F.greatest(F.abs("step") - 1, F.lit(0))
        grown = (
            grown.withColumn("step", steps)
            .withColumn("gap", (F.col("gap") + beyond * beyond).cast("int"))
            .where(F.col("gap") <= d)
            .withColumn("b", F.concat("ahead", F.array(F.col("a")[k] + F.col("step"))))
            .drop("ahead", "step")
        )
        if apart:
            grown = grown.where("a <= b")
        pairs = grown.join(b, "b")
        if apart:
            pairs = pairs.where("least(a_lo, b_lo) < greatest(a_hi, b_hi)")
        pairs = pairs.select("a", "b", "gap")
        if k == 1:  # few rows yet that many grow from: dealt over all cores
            cores = left.sparkSession.sparkContext.defaultParallelism
            pairs = pairs.repartition(4 * cores, "a", "b")
    return pairs.select("a", "b")


def _reaches(d: int) -> list[int]:
    """How far cells are looked for, round by round."""
    return [1] if d <= LISTED_FEATURES else [1, math.isqrt(d - 1) + 1]


def _box(names: Sequence[str]) -> list[Column]:
    return [
        F.array(*[F.min(ref(n)) for n in names]).alias("lo"),
        F.array(*[F.max(ref(n)) for n in names]).alias("hi"),
    ]


def _sum_squares(parts: list[Column]) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p * p
    return total


def _box_distances(a_lo, a_hi, b_lo, b_hi, d: int) -> tuple[Column, Column]:
    """Squared smallest and largest distance of two boxes given as arrays."""
    zero = F.lit(0.0)
    least = [F.greatest(zero, a_lo[i] - b_hi[i], b_lo[i] - a_hi[i]) for i in range(d)]
    most = [F.greatest(a_hi[i] - b_lo[i], b_hi[i] - a_lo[i]) for i in range(d)]
    return _sum_squares(least), _sum_squares(most)


def _point_pairs(
    points: DataFrame, others: DataFrame, names: Sequence[str], eps: float, offsets, reach: int
) -> DataFrame:
    """(point, cell) pairs of ``points`` with nearby cells of ``others`` that need a look.

    Adds ``whole``: every point of the cell is in reach. Cells out of reach
    are dropped on their bounding box. ``reach`` counts beyond three features.
    """
    d = len(names)
    boxes = others.groupBy("cell").agg(F.sum("weight").alias("cell_weight"), *_box(names))
    at = F.array(*[ref(n) for n in names])
    if d <= LISTED_FEATURES:
        around = points.select(at.alias("at"), _nearby(F.col("cell"), offsets).alias("cell"))
    else:
        near = _near_cells(points, others, d, reach).select("a", F.col("b").alias("cell"))
        around = points.select(at.alias("at"), F.col("cell").alias("a")).join(near, "a").drop("a")
    joined = around.join(boxes, "cell")
    least, most = _box_distances(F.col("at"), F.col("at"), F.col("lo"), F.col("hi"), d)
    limit = F.lit(eps * eps)
    return joined.where(least <= limit).select(
        "at", "cell", "cell_weight", (most <= limit).alias("whole")
    )


def _within(pairs: DataFrame, others: DataFrame, names: Sequence[str], eps: float) -> DataFrame:
    """The points of partly reached cells that are in reach."""
    gap = _sum_squares([F.col("at")[i] - ref(n) for i, n in enumerate(names)])
    return (
        pairs.where(~F.col("whole"))
        .select("at", "cell")
        .join(others, "cell")
        .where(gap <= F.lit(eps * eps))
    )


def _met_cells(
    boxes: DataFrame, roots: DataFrame, d: int, reach: int, offsets
) -> DataFrame:
    """Pairs (a, b) of nearby cells with different roots, each pair once, with their boxes."""
    if d <= LISTED_FEATURES:
        halves = [o for o in offsets if o > (0,) * d]
        pairs = boxes.select(F.col("cell").alias("a"), _nearby(F.col("cell"), halves).alias("b"))
    else:
        cells = roots.select(F.col("node").alias("cell"), "root")
        pairs = _near_cells(cells, cells, d, reach, apart=True)
    for side in ("a", "b"):
        own = [F.col(c).alias(f"{side}_{c}") for c in ("lo", "hi", "one")]
        pairs = pairs.join(boxes.select(F.col("cell").alias(side), *own), side)
    return pairs


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` after the cells of each edge (a, b) got the same one."""
    links = _apart(edges.select("a", "b"), roots, "root_a", "root_b")
    links = written(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    if links.isEmpty():
        return roots
    above = connected_components(roots.select(F.col("root").alias("node")).distinct(), links)
    above = above.select(F.col("node").alias("old"), "root")
    return written(
        roots.select("node", F.col("root").alias("old")).join(above, "old").select("node", "root")
    )


def _apart(pairs: DataFrame, roots: DataFrame, root_a: str, root_b: str) -> DataFrame:
    """Pairs (a, b) whose cells have different roots, with these."""
    for side, name in (("a", root_a), ("b", root_b)):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(name)), side)
    return pairs.where(F.col(root_a) != F.col(root_b))


def _joined_cells(
    core: DataFrame, names: Sequence[str], eps: float, side: float, offsets
) -> DataFrame:
    """node, root: the same root for all cells joined by core points within ``eps``.

    Cells touch if their boxes lie within ``eps`` altogether, or if one point of
    each does. Only pairs that are still apart after that are halved.
    """
    d = len(names)
    limit = F.lit(eps * eps)
    at = F.array(*[ref(n) for n in names])
    boxes = written(core.groupBy("cell").agg(*_box(names), F.min(at).alias("one")))
    least, most = _box_distances(
        F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), d
    )
    between = _sum_squares([F.col("a_one")[i] - F.col("b_one")[i] for i in range(d)])
    roots = boxes.select(F.col("cell").alias("node"), F.col("cell").alias("root"))
    for reach in _reaches(d):
        judged = written(
            _met_cells(boxes, roots, d, reach, offsets)
            .withColumns({"least": least, "most": most})
            .where(F.col("least") <= limit)
            .select("a", "b", ((F.col("most") <= limit) | (between <= limit)).alias("touches"))
        )
        roots = _joined(roots, judged.where("touches"))
        unsure = _apart(judged.where(~F.col("touches")), roots, "root_a", "root_b").select(
            "a", "b", F.col("a").alias("a_part"), F.col("b").alias("b_part")
        )
        roots = _halved(core, names, limit, side, unsure, roots)
    return roots


def _halved(
    core: DataFrame, names: Sequence[str], limit: Column, side: float, unsure: DataFrame, roots: DataFrame
) -> DataFrame:
    """``roots`` after every pair of ``unsure`` was settled on boxes that are halved again and again."""
    least, most = _box_distances(
        F.col("a_lo"), F.col("a_hi"), F.col("b_lo"), F.col("b_hi"), len(names)
    )
    unsure = written(unsure)
    scale = side
    while not unsure.isEmpty():
        scale = scale / 2
        halved = core.select(
            "cell",
            _cell(names, scale * 2).alias("part") if scale < side / 2 else F.col("cell").alias("part"),
            _cell(names, scale).alias("child"),
            *[ref(n) for n in names],
        )
        children = halved.groupBy("cell", "part", "child").agg(*_box(names))
        left = children.select(
            F.col("cell").alias("a"),
            F.col("part").alias("a_part"),
            F.col("child").alias("a_child"),
            F.col("lo").alias("a_lo"),
            F.col("hi").alias("a_hi"),
        )
        right = children.select(
            F.col("cell").alias("b"),
            F.col("part").alias("b_part"),
            F.col("child").alias("b_child"),
            F.col("lo").alias("b_lo"),
            F.col("hi").alias("b_hi"),
        )
        judged = written(
            unsure.join(left, ["a", "a_part"])
            .join(right, ["b", "b_part"])
            .withColumns({"least": least, "most": most})
            .where(F.col("least") <= limit)
            .select(
                "a",
                "b",
                F.col("a_child").alias("a_part"),
                F.col("b_child").alias("b_part"),
                (F.col("most") <= limit).alias("touches"),
            )
        )
        roots = _joined(roots, judged.where("touches"))
        unsure = written(
            _apart(judged.where(~F.col("touches")), roots, "root_a", "root_b").select(
                "a", "b", "a_part", "b_part"
            )
        )
    return roots


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the same root for all nodes joined by (a, b) edges.

    Every round hooks each node to its smallest neighbour and replaces edge
    ends by their new roots, so the graph shrinks quickly.
    """
    roots = nodes.select("node", F.col("node").alias("root"))
    left = written(edges.select("a", "b").distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(
            both.groupBy(F.col("a").alias("root"))
            .agg(F.min("b").alias("smallest"))
            .select("root", F.least("root", "smallest").alias("parent"))
        )
        grand = hooks.select(F.col("root").alias("parent"), F.col("parent").alias("above"))
        # Two hops: the parent's own parent where it has one.
        jumped = written(
            hooks.join(grand, "parent", "left").select(
                "root", F.coalesce("above", "parent").alias("parent")
            )
        )
        roots = written(
            roots.join(jumped, "root", "left").select(
                "node", F.coalesce("parent", "root").alias("root")
            )
        )
        a = jumped.select(F.col("root").alias("a"), F.col("parent").alias("new_a"))
        b = jumped.select(F.col("root").alias("b"), F.col("parent").alias("new_b"))
        left = written(
            left.join(a, "a", "left")
            .join(b, "b", "left")
            .select(
                F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b")
            )
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
    return roots


def dbscan(df: DataFrame, names: Sequence[str], eps: float, min_points: int) -> DataFrame:
    """``df`` plus ``cluster``: 0, 1, ... and -1 for noise.

    A border point in reach of several clusters joins the first of them.
    """
    if len(set(names)) < len(names):
        raise ValueError("a feature is named twice")
    d = len(names)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    offsets = _offsets(d) if d <= LISTED_FEATURES else []
    # -0.0 and 0.0 are one coordinate.
    same_zero = df.withColumns({n: ref(n) + F.lit(0.0) for n in names})
    points = written(
        same_zero.groupBy(*[ref(n) for n in names])
        .agg(F.count(F.lit(1)).alias("weight"))
        .withColumn("cell", _cell(names, side))
    )
    heavy = (
        points.groupBy("cell")
        .agg(F.sum("weight").alias("cell_weight"))
        .where(F.col("cell_weight") >= min_points)
        .select("cell")
    )
    dense = points.join(heavy, "cell", "left_semi")
    sparse = points.join(heavy, "cell", "left_anti")

    at = F.array(*[ref(n) for n in names])
    sparse_at = sparse.withColumn("at", at)
    border, found = sparse_at, []
    for reach in _reaches(d):
        pairs = written(_point_pairs(border, points, names, eps, offsets, reach))
        reached = (
            pairs.where("whole")
            .select("at", F.col("cell_weight").alias("weight"))
            .unionByName(_within(pairs, points, names, eps).select("at", "weight"))
            .groupBy("at")
            .agg(F.sum("weight").alias("neighbours"))
        )
        found.append(written(reached.where(F.col("neighbours") >= min_points).select("at")))
        border = written(border.join(found[-1], "at", "left_anti"))
    core_at = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    sparse_core = sparse_at.join(core_at, "at", "left_semi").drop("at")
    core = written(dense.unionByName(sparse_core, allowMissingColumns=False))
    border = border.drop("at")

    roots = _joined_cells(core, names, eps, side, offsets)
    numbered = with_row_number(
        roots.select("root").distinct(), [F.col("root")], name="number"
    ).select("root", (F.col("number") - 1).cast("int").alias("cluster"))
    cells = written(roots.join(numbered, "root").select(F.col("node").alias("cell"), "cluster"))

    core_labels = core.join(cells, "cell").select(*[ref(n) for n in names], "cluster")
    near = written(_point_pairs(border, core, names, eps, offsets, _reaches(d)[-1]))
    border_cells = near.where("whole").select("at", "cell").unionByName(
        _within(near, core, names, eps).select("at", "cell")
    )
    border_labels = (
        border_cells.distinct()
        .join(cells, "cell")
        .groupBy("at")
        .agg(F.min("cluster").alias("cluster"))
        .select(*[F.col("at")[i].alias(n) for i, n in enumerate(names)], "cluster")
    )
    labels = core_labels.unionByName(border_labels)
    return same_zero.join(labels, list(names), "left").select(
        *[ref(c) for c in df.columns],
        F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"),
    )
