"""Points in polygons by a hierarchical grid cover.

Each polygon is covered with square cells. A cell that no edge touches is inside or outside as a whole; one that
edges touch is quartered until few edges matter to it, so cells are small where a border is intricate. Points
meet cells by equality of the cell number. Inside cells need no test; in border cells the point is ray-cast
against the edges of its cell's band, in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import materialise

# The side of a cell at level 0, a power of two, so that cell borders are exact numbers.
SIDE = 16.0
MAX_LEVEL = 10
MAX_EDGES = 12
CROWD = 4_096

EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"


def edges_of(rings: Column) -> Column:
    """All edges of the rings; a ring need not repeat its first corner, and edges of no length go."""

    def of_ring(ring):
        corners = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        onward = F.concat(F.slice(corners, 2, F.greatest(F.size(corners), F.lit(1))), F.slice(corners, 1, 1))
        pairs = F.arrays_zip(corners.alias("a"), onward.alias("b"))
        return F.transform(
            pairs,
            lambda e: F.struct(
                e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"), e["b"]["x"].alias("x2"), e["b"]["y"].alias("y2")
            ),
        )

    edges = F.flatten(F.transform(F.filter(rings, lambda r: r.isNotNull()), of_ring))
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _crossings(edges: Column, x: Column, y: Column) -> Column:
    """How many edges a ray from the point to the right crosses; the lower end of an edge counts, the upper not."""

    def crossed(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.coalesce(spans & (x < at), F.lit(False))

    return F.size(F.filter(edges, crossed))


def _on_border(edges: Column, x: Column, y: Column) -> Column:
    def holds(e):
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (turn == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    return F.exists(edges, holds)


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point is in the polygon: an odd number of crossings, or on an edge or corner of any ring."""
    return (_crossings(edges, x, y) % 2 == 1) | _on_border(edges, x, y)


def _touched(edges: Column, x: Column, y: Column, side: Column) -> Column:
    """Whether an edge may touch the closed cell; in doubt, yes."""

    def touches(e):
        apart = (
            (F.greatest(e["x1"], e["x2"]) < x) | (F.least(e["x1"], e["x2"]) > x + side)
            | (F.greatest(e["y1"], e["y2"]) < y) | (F.least(e["y1"], e["y2"]) > y + side)
        )
        turns = [
            (e["x2"] - e["x1"]) * (cy - e["y1"]) - (e["y2"] - e["y1"]) * (cx - e["x1"])
            for cx in (x, x + side) for cy in (y, y + side)
        ]
        slack = F.lit(1e-9) * (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * (F.abs(x) + F.abs(y) + side)
        one_side = (F.least(*turns) > slack) | (F.greatest(*turns) < -slack)
        return ~apart & ~one_side

    return F.exists(edges, touches)


def _band(edges: Column, x: Column, y: Column, side: Column) -> Column:
    """The edges that matter to points of the cell: at its height, and not wholly to its left."""
    return F.filter(
        edges,
        lambda e: (F.least(e["y1"], e["y2"]) <= y + side) & (F.greatest(e["y1"], e["y2"]) >= y)
        & (F.greatest(e["x1"], e["x2"]) >= x),
    )


def grid_cover(
    polygons: DataFrame, id_col: str = "district_id", rings_col: str = "rings",
    max_level: int = MAX_LEVEL, max_edges: int = MAX_EDGES,
) -> DataFrame:
    """(district_id, level, cx, cy, inner, edges): the cells of every polygon, edges only where they matter.

    A cell is quartered while more than ``max_edges`` edges matter to it, down to ``max_level``. Each level is written.
    """
    edges = edges_of(F.col(f"`{rings_col}`"))
    shapes = polygons.select(F.col(f"`{id_col}`").alias("district_id"), edges.alias("edges"))
    shapes = shapes.filter(F.col("district_id").isNotNull() & (F.size("edges") > 0))

    def ends(axis: str) -> tuple[Column, Column]:
        both = F.concat(F.col(f"edges.{axis}1"), F.col(f"edges.{axis}2"))
        return F.floor(F.array_min(both) / SIDE), F.floor(F.array_max(both) / SIDE)

    cells = shapes.withColumn("cx", F.explode(F.sequence(*ends("x"))))
    cells = cells.withColumn("cy", F.explode(F.sequence(*ends("y"))))
    done = []
    for level in range(max_level + 1):
        side = F.lit(SIDE / (1 << level))
        x, y = F.col("cx") * side, F.col("cy") * side
        judged = (
            cells.withColumn("edges", _band(F.col("edges"), x, y, side))
            .withColumn("touched", _touched(F.col("edges"), x, y, side))
            .withColumn("inner", ~F.col("touched") & (_crossings(F.col("edges"), x + side / 2, y + side / 2) % 2 == 1))
            .filter("touched OR inner")
        )
        judged = materialise(judged, f"cells-{level}")
        last = F.col("inner") | (F.size("edges") <= max_edges) | F.lit(level == max_level)
        kept = F.when(~F.col("inner"), F.col("edges")).otherwise(F.array().cast(f"array<{EDGE}>"))
        done.append(judged.filter(last).select(
            "district_id", F.lit(level).alias("level"), "cx", "cy", "inner", kept.alias("edges")))
        cells = judged.filter(~last).select("district_id", "cx", "cy", "edges")
        if level < max_level and cells.isEmpty():
            break
        for axis in ("cx", "cy"):
            cells = cells.withColumn(axis, F.explode(F.array(2 * F.col(axis), 2 * F.col(axis) + 1)))
    cover = done[0]
    for more in done[1:]:
        cover = cover.unionByName(more)
    return materialise(cover, "cover")


def point_districts(
    points: DataFrame, polygons: DataFrame,
    point_id: str = "facility_id", x_col: str = "longitude", y_col: str = "latitude",
    district_id: str = "district_id", rings_col: str = "rings",
    max_level: int = MAX_LEVEL, max_edges: int = MAX_EDGES, crowd: int = CROWD,
) -> DataFrame:
    """(point_id, district_id) for every polygon that holds a point, its border included.

    ``rings`` is an array of rings of (x, y) corners: a point is inside where it lies in an odd number of rings, so
    holes and separate parts need no order; points on an edge or corner of any ring, holes too, are inside.
    Overlapping polygons give a row each. Points with a NULL or non-finite coordinate or without an id are in none;
    repeated point rows give their rows again; NULL ids and polygons without edges hold nothing; corners with a NULL coordinate are
    skipped. Empty tables give no rows. Cells that many points share are dealt to several tasks, with
    the cell's few cover rows repeated. Further columns are ignored. Runs jobs while it is being defined.
    """
    cover = grid_cover(polygons, district_id, rings_col, max_level, max_edges)
    levels = sorted(r[0] for r in cover.select("level").distinct().collect())
    x, y = F.col("x"), F.col("y")
    placed = points.select(
        F.col(f"`{point_id}`").alias("point_id"), F.col(f"`{x_col}`").cast("double").alias("x"),
        F.col(f"`{y_col}`").cast("double").alias("y"),
    ).filter(F.col("point_id").isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf")))
    keys = [
        F.struct(F.lit(lv).alias("level"), *[
            F.floor(c / (SIDE / (1 << lv))).alias(n) for c, n in ((x, "cx"), (y, "cy"))])
        for lv in levels
    ]
    cell = ["level", "cx", "cy"]
    if not keys:
        keys = [F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))]
    met = placed.withColumn("cell", F.explode(F.array(*keys))).select("point_id", "x", "y", "cell.*")
    # Only cells that are covered count, so sizes are few; the crowded ones among them are at most rows / crowd.
    sizes = met.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("parts"))
    crowded = sizes.filter("parts > 1")
    met = met.join(crowded, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("point_id", "x", "y"), F.col("parts")).cast("int")).drop("parts")
    spread = cover.join(crowded, cell, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    ).drop("parts")
    joined = met.join(spread, [*cell, "part"])
    return joined.filter(F.col("inner") | contains(F.col("edges"), x, y)).select("point_id", "district_id")


def attach_polygon_district(points: DataFrame, polygons: DataFrame, **names) -> DataFrame:
    """(point_id, district_id, n_districts, district_source) for every point row with an id.

    The smallest district that holds the point, and how many do; without one NULL, 0 and ``unresolved``.
    """
    point_id = names.get("point_id", "facility_id")
    found = point_districts(points.dropDuplicates([point_id]), polygons, **names)
    found = found.groupBy("point_id").agg(F.min("district_id").alias("district_id"), F.count("*").alias("n_districts"))
    rows = points.select(F.col(f"`{point_id}`").alias("point_id")).filter("point_id IS NOT NULL").distinct()
    return rows.join(found, "point_id", "left").select(
        "point_id", "district_id", F.coalesce("n_districts", F.lit(0)).alias("n_districts"),
        F.when(F.col("district_id").isNull(), F.lit("unresolved")).otherwise(F.lit("polygon")).alias("district_source"),
    )
