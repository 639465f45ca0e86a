"""Boxes on pages: expansion, overlap, grouping, reading order.

A page is one row here once its boxes are gathered: order and links within a page decide, and a page holds few boxes.
``MOST_BOXES`` states that bound; a page above it ends the query with an error instead of filling a task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = ("x_min", "y_min", "x_max", "y_max")
#: Boxes that a page may hold; a thousand lines of text are far fewer.
MOST_BOXES = 20_000
#: Boxes of a page that are compared at a time.
BLOCK = 1000


def poly_box(poly: Column) -> Column:
    """The box around a polygon, an array of [x, y]."""
    at = lambda i: F.transform(poly, lambda p: p[i])
    return F.struct(F.array_min(at(0)).alias("x_min"), F.array_min(at(1)).alias("y_min"), F.array_max(at(0)).alias("x_max"), F.array_max(at(1)).alias("y_max"))


def box_poly(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Lower left, upper left, upper right, lower right."""
    return F.array(F.array(x_min, y_max), F.array(x_min, y_min), F.array(x_max, y_min), F.array(x_max, y_max))


def expanded(low: Column, high: Column, ratio: float | None = None, pixel: float | None = None, limit: Column | None = None) -> tuple[Column, Column]:
    """A range made longer on both sides: to ``ratio`` times its length, else by ``pixel``.

    The growth of one side is rounded half-even and then added, so that a range keeps its centre; the ends are clamped to 0
    and the limit only where a limit is given.
    """
    length = (high - low).cast("double")
    more = (length * float(ratio) - length) / 2 if ratio is not None else F.lit(float(pixel or 0))
    step = F.bround(more).cast("int")
    a, b = low.cast("int") - step, high.cast("int") + step
    return (a, b) if limit is None else (F.when(a < 0, 0).otherwise(a), F.when(b > limit, limit.cast("int")).otherwise(b))


def _grown(boxes: DataFrame, page: str, index: str, width_ratio: float | None, height_ratio: float | None, *more: Column) -> DataFrame:
    x, y = expanded(F.col("x_min"), F.col("x_max"), ratio=width_ratio), expanded(F.col("y_min"), F.col("y_max"), ratio=height_ratio)
    return boxes.select(F.col(page).alias("page"), F.col(index).alias("i"), x[0].alias("x0"), x[1].alias("x1"), y[0].alias("y0"), y[1].alias("y1"), *more)


def overlapping(boxes: DataFrame, page: str, index: str, width_ratio: float | None = 1.0, height_ratio: float | None = 1.0) -> DataFrame:
    """(page, a, b) with a < b for boxes of a page that overlap once both are expanded; touching counts.

    An equi-join on the page with the ranges as residual; a page holds a bounded number of boxes.
    """
    grown = _grown(boxes, page, index, width_ratio, height_ratio)
    a, b = grown.alias("a"), grown.alias("b")
    hit = (F.col("a.page") == F.col("b.page")) & (F.col("a.i") < F.col("b.i"))
    hit &= (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    return a.join(b, hit).select(F.col("a.page").alias("page"), F.col("a.i").alias("a"), F.col("b.i").alias("b"))


def _by_page(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(page, boxes): the boxes of each page in order of their fields; an error for a page above the bound."""
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("boxes"))
    tight = F.when(F.size("boxes") <= MOST_BOXES, F.col("boxes")).otherwise(F.raise_error(F.lit(f"a page holds more than {MOST_BOXES} boxes")))
    return pages.select("page", tight.alias("boxes"))


def _smallest_linked(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """For each box the place of the first box that it is linked with, through others too: smallest labels spread until none changes."""
    n = len(x0)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, n, BLOCK):
        some = slice(start, start + BLOCK)
        hit = (x0[some, None] <= x1[None]) & (x0[None] <= x1[some, None]) & (y0[some, None] <= y1[None]) & (y0[None] <= y1[some, None])
        a, b = np.nonzero(hit)
        links.append((a + start, b))
    a, b = (np.concatenate(part) for part in zip(*links)) if links else (np.empty(0, int), np.empty(0, int))
    label = np.arange(n)
    while True:
        spread = label.copy()
        np.minimum.at(spread, a, label[b])
        spread = spread[spread]
        if (spread == label).all():
            return label
        label = spread


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _components_udf(pages: pd.Series) -> pd.Series:
    def one(boxes) -> np.ndarray:
        corners = (np.array([b[name] for b in boxes], np.int64) for name in ("x0", "x1", "y0", "y1"))
        return np.array([b["i"] for b in boxes], np.int32)[_smallest_linked(*corners)]

    return pages.map(one)


def components(boxes: DataFrame, page: str, index: str, width_ratio: float | None = 1.0, height_ratio: float | None = 1.0) -> DataFrame:
    """(page, i, component): the smallest index that a box is linked with, through others too; one shuffle, by page."""
    pages = _by_page(_grown(boxes, page, index, width_ratio, height_ratio), ["i", "x0", "x1", "y0", "y1"])
    return pages.select("page", F.inline(F.arrays_zip(F.transform("boxes", lambda b: b["i"]).alias("i"), _components_udf("boxes").alias("component"))))


def reading_groups(boxes: DataFrame, page: str, index: str, text: str, width_ratio: float | None = None, height_ratio: float | None = 2.0) -> DataFrame:
    """(page, group_no, box, contents, counts): overlapping boxes as groups in reading order.

    Members and groups are ordered by the centres of their boxes, from above, then from the left; ``box`` is the polygon of
    the first member, ``contents`` the members' texts joined by line breaks (null counts as empty).
    """
    y, x = (F.col("y_min") + F.col("y_max")) / 2, (F.col("x_min") + F.col("x_max")) / 2
    grown = _grown(boxes, page, index, width_ratio, height_ratio, y.alias("y"), x.alias("x"), F.coalesce(F.col(text), F.lit("")).alias("t"), box_poly(*(F.col(c) for c in BOX)).alias("p"))
    pages = _by_page(grown, ["i", "x0", "x1", "y0", "y1", "y", "x", "t", "p"]).withColumn("roots", _components_udf("boxes"))
    member = F.transform(F.arrays_zip("boxes", "roots"), lambda z: F.struct(z["boxes"]["y"].alias("y"), z["boxes"]["x"].alias("x"), z["boxes"]["i"].alias("i"), z["boxes"]["t"].alias("t"), z["boxes"]["p"].alias("p"), z["roots"].alias("root")))
    ordered = pages.select("page", F.array_sort(member).alias("m"))
    # a group comes where its first member does, so the distinct roots in order of members number the groups
    groups = ordered.select("page", "m", F.posexplode(F.array_distinct(F.transform("m", lambda e: e["root"]))).alias("group_no", "root"))
    own = groups.select("page", "group_no", F.filter("m", lambda e: e["root"] == F.col("root")).alias("g"))
    return own.select("page", "group_no", F.col("g")[0]["p"].alias("box"), F.array_join(F.transform("g", lambda e: e["t"]), "\n").alias("contents"), F.size("g").alias("counts"))


def _rectangles(x: np.ndarray, y: np.ndarray, eps_x: float, eps_y: float, least: int) -> list[list[int]]:
    """Clusters of points in their order, before they are sorted.

    The points lie in a grid of cells as large as the reach, so a point's neighbours are in its own cell and the eight
    around it.  Crowded points found a cluster in turn and take what neighbours no earlier one took.
    """
    cell_x, cell_y = np.floor(x / (eps_x or 1)).astype(int), np.floor(y / (eps_y or 1)).astype(int)
    grid: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, cell in enumerate(zip(cell_x.tolist(), cell_y.tolist())):
        grid[cell].append(i)
    owner: dict[int, int] = {}
    clusters: list[list[int]] = []
    for i, (cx, cy) in enumerate(zip(cell_x.tolist(), cell_y.tolist())):
        if i in owner:
            continue
        around = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in grid.get((cx + dx, cy + dy), ())]
        near = sorted(j for j in around if abs(x[j] - x[i]) <= eps_x and abs(y[j] - y[i]) <= eps_y)
        if len(near) >= least:
            fresh = [j for j in near if j not in owner]
            owner.update(dict.fromkeys(fresh, len(clusters)))
            clusters.append(fresh)
    return clusters + [[i] for i in range(len(x)) if i not in owner]


def greedy_clusters(points: DataFrame, page: str, index: str, eps_x: float, eps_y: float, least: int = 1) -> DataFrame:
    """(page, i, cluster): points in order of their index found a cluster with their neighbours in a rectangle; not transitive.

    All neighbours, the point among them, count towards ``least``, only free ones join; what is left stands alone.
    Clusters are numbered in the order of the means of y, then of x, ties in the order in which they were found.
    """

    @F.pandas_udf("array<int>")
    def clustered(ordered: pd.Series) -> pd.Series:
        def one(own) -> np.ndarray:
            x, y = (np.array([p[name] for p in own], np.float64) for name in ("x", "y"))
            found = sorted(_rectangles(x, y, eps_x, eps_y, least), key=lambda c: (y[c].mean(), x[c].mean()))
            number = np.empty(len(x), np.int32)
            for n, members in enumerate(found):
                number[members] = n
            return number

        return ordered.map(one)

    placed = points.select(F.col(page).alias("page"), F.col(index).alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _by_page(placed, ["i", "x", "y"]).select("page", F.inline(F.arrays_zip(F.transform("boxes", lambda e: e["i"]).alias("i"), clustered("boxes").alias("cluster"))))


def crops(detections: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Detections (poly, score, width, height of the page, other columns) with the box of their crop and the ratio used.

    Columns ``x_min`` to ``y_max`` are added or replaced, ``expand_ratio`` too; the polygon and the score stay.
    """
    box = poly_box(F.col("poly"))
    x = expanded(box["x_min"], box["x_max"], ratio=ratio, limit=F.col("width"))
    y = expanded(box["y_min"], box["y_max"], ratio=ratio, limit=F.col("height"))
    return detections.withColumns({"x_min": x[0], "y_min": y[0], "x_max": x[1], "y_max": y[1], "expand_ratio": F.lit(float(ratio))})
