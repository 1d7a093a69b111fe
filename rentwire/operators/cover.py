"""Points in a table of drawn shapes: each shape is covered by cells of a quadtree, and points meet the cells by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shapes
from .tables import cut, partitions

#: Cells of a shape, about: border cells are split in four until there are so many, or the cells are of DEEPEST level (two metres).
MOST, DEEPEST = 96, 24
#: Degrees by which a cell is taken for larger than it is when it is compared with a shape.
SLACK = 1e-9
CELLS = "shape_id string, level int, cy long, cx long, inside boolean"


def sides(level: int) -> tuple[float, float]:
    """Height and width of a cell in degrees."""
    return 180.0 / 2**level, 360.0 / 2**level


def touched(kind: str, points: np.ndarray, radius: float, south, west, north, east) -> tuple[np.ndarray, np.ndarray]:
    """Whether the border of a shape may run through each box, and whether the box lies inside it (where the border doesn't)."""
    if kind == "circle":
        lat, lon = points[0]
        turn = np.radians

        def metres(y, x):
            h = np.sin(turn(y - lat) / 2) ** 2 + np.cos(turn(lat)) * np.cos(turn(y)) * np.sin(turn(x - lon) / 2) ** 2
            return 2 * shapes.RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))

        corners = np.stack([metres(y, x) for y in (south, north) for x in (west, east)])
        middle = metres((south + north) / 2, (west + east) / 2)
        reach = np.radians(np.hypot(north - south, east - west) / 2) * shapes.RADIUS_M  # no point of the box is further from its middle
        inside = corners.max(axis=0) < radius - 1e-3
        return ~inside & (middle - reach <= radius + 1e-3), inside
    if kind == "rectangle":
        (low_y, low_x), (high_y, high_x) = points.min(axis=0), points.max(axis=0)
        inside = (south > low_y) & (north < high_y) & (west > low_x) & (east < high_x)
        return ~inside & (south <= high_y) & (north >= low_y) & (west <= high_x) & (east >= low_x), inside
    a, b = points, np.roll(points, 1, axis=0)
    touch, odd = np.zeros(len(south), bool), np.zeros(len(south), bool)
    mid_y, mid_x = (south + north) / 2, (west + east) / 2
    for (ay, ax), (by, bx) in zip(a, b):
        near = (south <= max(ay, by)) & (north >= min(ay, by)) & (west <= max(ax, bx)) & (east >= min(ax, bx))
        turn = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for y in (south, north) for x in (west, east)]
        one_side = (np.min(turn, axis=0) > 0) | (np.max(turn, axis=0) < 0)
        touch |= near & ~one_side
        if ay != by:
            odd ^= ((ay > mid_y) != (by > mid_y)) & (mid_x < (bx - ax) * (mid_y - ay) / (by - ay) + ax)
    return touch, ~touch & odd


def cells(kind: str, points: np.ndarray, radius: float, most: int = MOST) -> list[tuple[int, int, int, bool]]:
    """level, cy, cx and whether the cell lies inside, of cells that don't overlap and together hold the shape."""
    if not len(points) or (kind == "polygon" and len(points) < 3):
        return []
    south, west, north, east = shapes.bounds(shapes.Shape(kind, tuple(map(tuple, points.tolist())), radius))
    level = 0
    while level < DEEPEST and sides(level + 1)[0] >= north - south and sides(level + 1)[1] >= east - west:
        level += 1
    height, width = sides(level)
    ys, xs = (np.arange(int((low + origin) // side), int((high + origin) // side) + 1) for low, high, origin, side in ((south, north, 90, height), (west, east, 180, width)))
    cy, cx, found = np.repeat(ys, len(xs)), np.tile(xs, len(ys)), []
    while True:
        height, width = sides(level)
        box = cy * height - 90 - SLACK, cx * width - 180 - SLACK, (cy + 1) * height - 90 + SLACK, (cx + 1) * width - 180 + SLACK
        border, inside = touched(kind, points, radius, *box)
        found += [(level, int(y), int(x), True) for y, x in zip(cy[inside], cx[inside])]
        cy, cx = cy[border], cx[border]
        if level == DEEPEST or len(found) + 2 * len(cy) > most or not len(cy):
            return found + [(level, int(y), int(x), False) for y, x in zip(cy, cx)]
        cy, cx = np.concatenate([2 * cy + d for d in (0, 0, 1, 1)]), np.concatenate([2 * cx + d for d in (0, 1, 0, 1)])
        level += 1


def cover(drawn: DataFrame, most: int = MOST) -> DataFrame:
    """CELLS of drawn shapes (shape_id, kind, ring: array of (lat, lon), radius in metres), as in ``shapes.Shape``.

    Shapes are dealt over all tasks: a small file of them is much work.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                points = np.array([(p["lat"], p["lon"]) for p in r["ring"] or []], float).reshape(-1, 2)
                rows += [(r["shape_id"], *c) for c in cells(r["kind"], points, r["radius"] or 0.0, most)]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shape_id", "level", "cy", "cx", "inside"])

    told = drawn.select(F.col("shape_id").cast("string").alias("shape_id"), "kind", "ring", F.col("radius").cast("double").alias("radius"))
    return told.repartition(partitions(drawn.sparkSession)).mapInArrow(run, CELLS)


def holds(kind: Column, ring: Column, radius: Column, lat: Column, lon: Column) -> Column:
    """Whether a shape of a table holds a point, by the rules of ``shapes.contains``."""
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    box = lat.between(F.array_min(lats), F.array_max(lats)) & lon.between(F.array_min(lons), F.array_max(lons))
    middle = F.element_at(ring, 1)
    return F.when(kind == "rectangle", box).when(kind == "circle", shapes.haversine(middle["lat"], middle["lon"], lat, lon) <= radius).otherwise(box & shapes.ring_contains(ring, lat, lon))


def _keys(levels: list[int]) -> Column:
    """The cell of each level that holds (lat, lon)."""
    lat, lon = F.col("lat"), F.col("lon")
    return F.array(*(F.struct(F.lit(n).alias("level"), F.floor((lat + 90) / sides(n)[0]).alias("cy"), F.floor((lon + 180) / sides(n)[1]).alias("cx")) for n in levels))


def _covered(drawn: DataFrame, most: int, scratch: list[str] | None) -> tuple[DataFrame, list[int]]:
    """key, shape_id and sure of the cells, as a written table, and their levels (DEEPEST + 1 at most)."""
    covered = cut(cover(drawn, most), scratch)
    levels = sorted(r.level for r in covered.select("level").distinct().collect())
    return covered.select(F.struct("level", "cy", "cx").alias("key"), "shape_id", F.col("inside").alias("sure")), levels


def _tested(met: DataFrame, drawn: DataFrame) -> DataFrame:
    """Of the rows (point, shape_id, sure) of cells at a border those whose shape holds the point."""
    own = drawn.select(F.col("shape_id").cast("string").alias("shape_id"), "kind", "ring", "radius")
    return met.filter(~F.col("sure")).join(own, "shape_id").filter(holds(F.col("kind"), F.col("ring"), F.col("radius"), F.col("point.lat"), F.col("point.lon")))


def inside(points: DataFrame, drawn: DataFrame, most: int = MOST, scratch: list[str] | None = None) -> DataFrame:
    """``points`` (lat, lon and any columns) with the shape_id of each shape that holds them: a row for each point and shape.

    A point has one cell of each level that the shapes' cells have (at most DEEPEST), and meets the cells of those keys: inside a
    shape without a test, at its border with the exact one. Points without coordinates and shapes without corners meet nothing.
    drawn: a row for each shape_id. scratch: gets the path of the table of cells.
    """
    covered, levels = _covered(drawn, most, scratch)
    located = points.filter("lat is not null and lon is not null")
    if not levels:
        return located.limit(0).withColumn("shape_id", F.lit("")).select(*points.columns, "shape_id")
    met = located.select(F.struct(*points.columns).alias("point"), F.explode(_keys(levels)).alias("key")).join(covered, "key")
    return met.filter("sure").select("point", "shape_id").unionByName(_tested(met, drawn).select("point", "shape_id")).select("point.*", "shape_id")


def counts(points: DataFrame, drawn: DataFrame, most: int = MOST, scratch: list[str] | None = None) -> DataFrame:
    """shape_id, n: how many of ``points`` (lat, lon) each shape holds, as ``inside`` would find them; shapes that hold none are left out.

    Points of one place count together, and cells inside a shape meet the sums of their points: work follows the number of
    cells and of the places at borders, not that of pairs of points and shapes. scratch: gets the paths of the written tables.
    """
    covered, levels = _covered(drawn, most, scratch)
    placed = cut(points.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count("*").alias("n")), scratch)
    if not levels:
        return placed.limit(0).select(F.lit("").alias("shape_id"), "n")
    at = placed.select(F.struct("lat", "lon", "n").alias("point"), F.explode(_keys(levels)).alias("key"))
    sums = at.groupBy("key").agg(F.sum("point.n").alias("n"))
    within = covered.filter("sure").join(sums, "key").select("shape_id", "n")
    border = _tested(at.join(covered.filter(~F.col("sure")), "key"), drawn).select("shape_id", F.col("point.n").alias("n"))
    return within.unionByName(border).groupBy("shape_id").agg(F.sum("n").alias("n"))
