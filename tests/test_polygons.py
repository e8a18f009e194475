"""The grid cover against ray casting of every point in every polygon."""

import random
from collections import Counter

import pytest

from attesta.operators.polygons import attach_polygon_district, grid_cover, point_districts

POLYGONS = "district_id long, rings array<array<struct<x:double,y:double>>>"
POINTS = "facility_id string, longitude double, latitude double"


def inside(rings, x, y):
    odd = False
    for ring in rings or []:
        ring = [p for p in ring or [] if None not in p]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            turn = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            if (x1, y1) != (x2, y2) and turn == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def wanted(points, polygons):
    return Counter(
        (p, d) for p, x, y in points for d, rings in polygons
        if p is not None and d is not None and None not in (x, y) and abs(x) < 1e300 and abs(y) < 1e300 and inside(rings, x, y)
    )


def wheel(rng, cx, cy, r, n):
    """A ring with an uneven rim; corners on multiples of an eighth, so that points can hit them."""
    import math

    return [
        (round(8 * (cx + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * i / n))) / 8,
         round(8 * (cy + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * i / n))) / 8)
        for i in range(n)
    ]


def shapes():
    rng = random.Random(2)
    out = [(i, [wheel(rng, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(1, 25), rng.choice([3, 5, 40, 200]))])
           for i in range(12)]
    out.append((20, [[(0, 0), (32, 0), (32, 32), (0, 32)], [(8, 8), (24, 8), (24, 24), (8, 24)], [(12, 12), (16, 12), (16, 16)]]))
    out.append((21, [[(-16, -16), (0, -16), (0, 0), (-16, 0), (-16, -16)], [(40, 40), (48, 40), (48, 48)]]))
    out += [(22, []), (23, None), (24, [[]]), (25, [[(1, 1)]]), (26, [None, [(2, 2), (5, 2), (None, 9), (5, 5)]]), (None, [[(0, 0), (9, 0), (9, 9)]])]
    return out


def shape_rows(polygons):
    """The polygons with all corners as floats."""
    as_float = lambda ring: ring and [tuple(None if v is None else float(v) for v in p) for p in ring]
    return [(d, rings and [as_float(r) for r in rings]) for d, rings in polygons]


def spots(polygons):
    rng = random.Random(3)
    out = [(str(i), rng.uniform(-70, 70), rng.uniform(-70, 70)) for i in range(1500)]
    out += [(f"g{i}-{j}", i * 4.0, j * 4.0) for i in range(-12, 13) for j in range(-12, 13)]
    corners = [p for _, rings in polygons for ring in rings or [] for p in ring or [] if None not in p]
    out += [(f"c{i}", x, y) for i, (x, y) in enumerate(corners)]
    out += [(f"m{i}", (a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for i, (a, b) in enumerate(zip(corners, corners[1:]))]
    nan = float("nan")
    out += [("n1", None, 1.0), ("n2", 1.0, None), ("n3", nan, 1.0), ("n4", 1.0, float("inf")), (None, 1.0, 1.0)]
    out = [(p, x if x is None else float(x), y if y is None else float(y)) for p, x, y in out]
    return out + [("7", 4.0, 4.0)] * 3


@pytest.mark.parametrize("max_level,max_edges,crowd", [(10, 12, 50_000), (6, 3, 40), (0, 1, 7)])
def test_points_equal_brute_force(spark, max_level, max_edges, crowd):
    """Also with one level only, and with cells that count as crowded from a few points on."""
    polygons = shape_rows(shapes())
    points = spots(polygons)
    df = spark.createDataFrame(points, POINTS).repartition(4).selectExpr("*", "1 AS level", "2 AS cx", "3 AS part", "4 AS x")
    shape = spark.createDataFrame(polygons, POLYGONS).selectExpr("*", "1 AS edges", "2 AS inner")
    got = point_districts(df, shape, max_level=max_level, max_edges=max_edges, crowd=crowd)
    assert Counter(tuple(r) for r in got.collect()) == wanted(points, polygons)


def test_cover_is_fine_only_at_intricate_borders(spark):
    shape = spark.createDataFrame([s for s in shape_rows(shapes()) if s[0] in (20, 3)], POLYGONS)
    cover = grid_cover(shape, max_edges=12).collect()
    assert all(c.inner or len(c.edges) <= 12 or c.level == 10 for c in cover)
    assert any(c.inner for c in cover) and {c.level for c in cover if c.district_id == 20} == {0}


def test_plan_has_no_pairing_of_all_rows(spark):
    found = point_districts(spark.createDataFrame([("a", 1.0, 1.0)], POINTS), spark.createDataFrame(shape_rows(shapes()), POLYGONS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_attached_and_empty(spark):
    polygons = shape_rows(shapes())
    points = [("in", 4.0, 4.0), ("in", 4.0, 4.0), ("hole", 20.0, 10.0), ("far", 500.0, 1.0), ("none", None, None), (None, 4.0, 4.0)]
    df, shape = spark.createDataFrame(points, POINTS), spark.createDataFrame(polygons, POLYGONS)
    held = {p: sorted(d for d, rings in polygons if d is not None and inside(rings, x, y)) if x else [] for p, x, y in points if p}
    want = {(p, d[0] if d else None, len(d), "polygon" if d else "unresolved") for p, d in held.items()}
    assert {tuple(r) for r in attach_polygon_district(df, shape, max_edges=50).collect()} == want
    none_points, none_shapes = spark.createDataFrame([], POINTS), spark.createDataFrame([], POLYGONS)
    assert point_districts(none_points, shape, max_edges=50).count() == 0 and point_districts(df, none_shapes, max_edges=50).count() == 0
