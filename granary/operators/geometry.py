"""Points, polygons and the strictly-within spatial join.

A polygon is a row with ``rings``: array<array<struct<x,y>>>, holes as further
rings; a multipolygon is several rows with one id. Each row is cut into the cells of
a quadtree of its own: a cell of more than ``SIDES`` sides is cut in four, each with
the sides that touch it (at most one cut for each side of the polygon). A cell also knows whether its lower right corner lies
inside, so a point in it is decided by the sides of the cell alone, and a cell
without sides lies wholly inside or is left out. So a polygon has about as many
cell sides as it has sides, whatever its area, and every point meets few of them.

Cells are squares of a size 2^level, named by (level, column, row). Distinct places
are looked up by equality of that name, for each level that any polygon has; the
exact test runs inside that join.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granary.functions.missing import ColumnOrName, as_col, is_in

RINGS = "array<array<struct<x:double,y:double>>>"
EARTH_RADIUS = 6378137.0  # fixed value: sphere of EPSG:3857, metres


def read_polygons(df: DataFrame, id: str, rings: str) -> DataFrame:
    """Polygon parts (id, rings) from a table with one ring array per part."""
    return df.select(F.col(id), F.col(rings).cast(RINGS).alias("rings")).where(F.size("rings") > 0)


def explode_parts(df: DataFrame, parts: str) -> DataFrame:
    """Multipolygons (array of ring arrays) to one row per part."""
    rest = [c for c in df.columns if c != parts]
    return df.select(*rest, F.posexplode(parts).alias("part", "rings"))


def _edges(rings: Column) -> Column:
    """All sides of all rings; a ring not closed in the data is closed here."""

    def sides(ring: Column) -> Column:
        ends = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            ends,
            lambda p, q: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, sides))


def _turn(e, x, y):
    """Positive if the point lies to the left of the side, zero if it lies on its line."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _right_of(e, x, y):
    """Whether the side crosses the level of the point to the right of it."""
    turn, upward = _turn(e, x, y), e["y2"] > e["y1"]
    return ((e["y1"] > y) != (e["y2"] > y)) & ((upward & (turn > 0)) | (~upward & (turn < 0)))


def _above(e, x, y):
    """Whether the side crosses the upright line through the point above it.

    A point on the side is moved to the right by a trifle, so rising sides are above it.
    """
    turn, rightward = _turn(e, x, y), e["x2"] > e["x1"]
    rising = (e["x2"] - e["x1"]) * (e["y2"] - e["y1"]) > 0
    over = (rightward & (turn < 0)) | (~rightward & (turn > 0)) | ((turn == 0) & rising)
    return ((e["x1"] > x) != (e["x2"] > x)) & over


def _inside(cell: Column, x: Column, y: Column) -> Column:
    """Strictly inside: the way to the cell's corner, level first and then down, crosses sides of the cell only."""

    def on_side(e: Column) -> Column:
        between = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        return between & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])) & (_turn(e, x, y) == 0)

    right, low = cell["right"], cell["low"]

    def passed(parity: Column, e: Column) -> Column:
        level = _right_of(e, x, y) != _right_of(e, right, y)
        return parity != (level != (_above(e, right, y) != _above(e, right, low)))

    odd = F.aggregate(cell["sides"], cell["inside"], passed)
    return ~F.exists(cell["sides"], on_side) & odd


SIDES = 32
DEEPEST = 30


def _odd(e: dict, x: float, y: float) -> bool:
    return bool(np.count_nonzero(_right_of(e, x, y)) & 1)


def quadtree(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, most: int = SIDES) -> Iterator[tuple]:
    """Cells (level, column, row, inside, sides) of one polygon's sides; ``sides`` are indices."""
    ends_x, ends_y = np.concatenate([x1, x2]), np.concatenate([y1, y2])
    extent = max(np.ptp(ends_x), np.ptp(ends_y)) if len(x1) else 0.0
    if not 0 < extent < np.inf:
        return  # nothing lies inside
    top, splits = int(np.ceil(np.log2(extent))), 0
    size, all_ = 2.0**top, {"x1": x1, "y1": y1, "x2": x2, "y2": y2}
    todo = deque()
    for column in range(int(np.floor(ends_x.min() / size)), int(np.floor(ends_x.max() / size)) + 1):
        for row in range(int(np.floor(ends_y.min() / size)), int(np.floor(ends_y.max() / size)) + 1):
            todo.append((top, column, row, _odd(all_, (column + 1) * size, row * size), np.arange(len(x1))))
    while todo:
        level, column, row, inside, near = todo.popleft()  # large cells first
        size = 2.0**level
        left, right, low, high = column * size, (column + 1) * size, row * size, (row + 1) * size
        e = {c: v[near] for c, v in all_.items()}
        touch = (np.maximum(e["x1"], e["x2"]) >= left) & (np.minimum(e["x1"], e["x2"]) <= right) & (np.maximum(e["y1"], e["y2"]) >= low) & (np.minimum(e["y1"], e["y2"]) <= high)
        corners = [_turn(e, x, y) for x in (left, right) for y in (low, high)]
        touch &= ~(np.all([c > 0 for c in corners], axis=0) | np.all([c < 0 for c in corners], axis=0))
        near, e = near[touch], {c: v[touch] for c, v in e.items()}
        # sides on top of each other stay together in any cell, so there is an end to splitting
        if len(near) <= most or level <= top - DEEPEST or splits > len(x1):
            if len(near) or inside:
                yield level, column, row, inside, near
            continue
        half, splits = size / 2, splits + 1
        for i in (0, 1):
            for j in (0, 1):
                x, y = left + (i + 1) * half, low + j * half
                # from the small cell's corner level to the right edge, then down to the corner that is known
                way = (_right_of(e, x, y) != _right_of(e, right, y)) != (_above(e, right, y) != _above(e, right, low))
                todo.append((level - 1, 2 * column + i, 2 * row + j, inside != bool(np.count_nonzero(way) & 1), near))


def polygon_cells(polygons: DataFrame, id: str, most: int = SIDES) -> DataFrame:
    """Rows (id, cell): level, column, row, corner, whether the corner is inside, and sides."""
    schema = T.StructType([T.StructField("id", polygons.schema[id].dataType)] + T._parse_datatype_string(CELL).fields)
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for key, *arrays in zip(batch.column(0), *(batch.column(i) for i in range(1, 5))):
                sides = [np.asarray(a.values.to_numpy(zero_copy_only=False), float) for a in arrays]
                whole = np.all([~np.isnan(a) for a in sides], axis=0)
                sides = [a[whole] for a in sides]
                for level, column, row, inside, near in quadtree(*sides, most):
                    listed = [dict(zip(("x1", "y1", "x2", "y2"), s)) for s in zip(*(a[near].tolist() for a in sides))]
                    out.append({"id": key.as_py(), "level": level, "column": column, "row": row, "right": (column + 1) * 2.0**level, "low": row * 2.0**level, "inside": inside, "sides": listed})
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    sides = polygons.select(F.col(id), _edges(F.col("rings")).alias("e"))
    cells = sides.select(id, *(F.col(f"e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))).mapInArrow(run, schema)
    return cells.select(F.col("id").alias(id), F.struct(*cells.columns[1:]).alias("cell"))


CELL = "level int, column long, row long, right double, low double, inside boolean, sides array<struct<x1:double,y1:double,x2:double,y2:double>>"


def within_join(points: DataFrame, polygons: DataFrame, id: str, x: str, y: str) -> DataFrame:
    """Left join of points to the polygons they lie strictly within.

    Unmatched points, and points without a place, keep a NULL id; a point in several
    polygons gives a row each. Polygons of one id are one, also where they overlap.
    """
    cells = polygon_cells(polygons, id)
    levels = cells.agg(F.collect_set("cell.level").alias("levels"))  # one row: a level for each power of two in use
    places = points.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null").distinct()
    keyed = places.join(F.broadcast(levels)).select("_x", "_y", F.explode("levels").alias("_level"))
    size = F.pow(F.lit(2.0), F.col("_level"))
    same = (F.col("_level") == F.col("cell.level")) & (F.floor(F.col("_x") / size) == F.col("cell.column")) & (F.floor(F.col("_y") / size) == F.col("cell.row"))
    hits = keyed.join(cells, same & _inside(F.col("cell"), F.col("_x"), F.col("_y"))).select("_x", "_y", F.col(id).alias("_id")).distinct()
    joined = points.join(hits, (F.col(x).cast("double") == F.col("_x")) & (F.col(y).cast("double") == F.col("_y")), "left")
    return joined.select(*[points[c] for c in points.columns], F.col("_id").alias(id))


def to_wgs84(x: ColumnOrName, y: ColumnOrName, crs: int = 3857) -> tuple[Column, Column]:
    """Longitude and latitude; Web Mercator is converted, EPSG:4326 passes."""
    x, y = as_col(x), as_col(y)
    if crs == 4326:
        return x, y
    if crs != 3857:
        raise ValueError("only EPSG:3857 and EPSG:4326 are known")
    lon = F.degrees(x / EARTH_RADIUS)
    lat = F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2)
    return lon, lat


def area_class(polygon_id: ColumnOrName, state: ColumnOrName, isolated: Iterable[str]) -> Column:
    """Urban in an urban polygon, isolated in listed states, otherwise rural."""
    return (
        F.when(as_col(polygon_id).isNotNull(), F.lit("urban"))
        .when(is_in(state, isolated), F.lit("isolated"))
        .otherwise(F.lit("rural"))
    )
