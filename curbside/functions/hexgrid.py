"""Hexagonal cells as column expressions: axial coordinates on Web Mercator.

A cell id is a BIGINT: level * 2^56 + (q + 2^27) * 2^28 + (r + 2^27), with q and r
the axial coordinates of a pointy-top hexagon. The edge length grows by
sqrt(7) per coarser level. Ids are this package's own scheme.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
EDGE_LEVEL_8 = 461.354684  # metres on the Mercator plane at level 8
MAX_LEVEL = 15
HALF = 1 << 27
SPAN = 1 << 28
SQRT3 = math.sqrt(3.0)
OFFSETS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def edge_length(level: int) -> float:
    return EDGE_LEVEL_8 * math.sqrt(7.0) ** (8 - level)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) metres of a WGS84 point on the spherical Mercator plane."""
    return (
        F.radians(lon) * EARTH_RADIUS,
        F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS,
    )


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) degrees."""
    return (
        F.degrees(F.atan(F.exp(y / EARTH_RADIUS)) * 2 - F.lit(math.pi / 2)),
        F.degrees(x / EARTH_RADIUS),
    )


def cell_id(q: Column, r: Column, level: int) -> Column:
    return (
        F.lit(level << 56).cast("bigint") + (q.cast("bigint") + HALF) * F.lit(SPAN).cast("bigint") + (r.cast("bigint") + HALF)
    )


def cell_parts(cell: Column) -> tuple[Column, Column]:
    """Axial (q, r) of a cell."""
    return (F.shiftright(cell, 28).bitwiseAND(F.lit(SPAN - 1)) - HALF, cell.bitwiseAND(F.lit(SPAN - 1)) - HALF)


def plane_cell(x: Column, y: Column, level: int) -> Column:
    size = edge_length(level)
    fq, fr = (x * (SQRT3 / 3) - y / 3) / size, y * (2.0 / 3) / size
    fs = -fq - fr
    q, r, s = F.rint(fq), F.rint(fr), F.rint(fs)
    # errors are compared on a 1e-8 grid, so that points on a boundary do not depend on the last bits
    dq, dr, ds = (F.rint(F.abs(e) * 1e8) for e in (q - fq, r - fr, s - fs))
    # the coordinate with the largest rounding error is rebuilt from the other two
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return cell_id(F.when(fix_q, -r - s).otherwise(q), F.when(fix_r, -q - s).otherwise(r), level)


def point_cell(lat: Column, lon: Column, level: int = 8) -> Column:
    return plane_cell(*mercator(lat, lon), level)


def cell_level(cell: Column) -> Column:
    """The level that the id holds."""
    return F.shiftright(cell, 56).cast("int")


def cell_edge(cell: Column) -> Column:
    """Edge length in metres on the plane, by the level in the id."""
    return F.element_at(F.array(*[F.lit(edge_length(k)) for k in range(MAX_LEVEL + 1)]), cell_level(cell) + 1)


def plane_centre(cell: Column) -> tuple[Column, Column]:
    q, r = cell_parts(cell)
    size = cell_edge(cell)
    return (q * SQRT3 + r * (SQRT3 / 2)) * size, r * (size * 1.5)


def cell_centre(cell: Column) -> tuple[Column, Column]:
    """(lat, lon) of the cell's centre."""
    return unmercator(*plane_centre(cell))


def _bound(value: Column, fn) -> Column:
    """fn(value) with the value computed once: a column used many times in one expression is otherwise repeated in the plan."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def cell_parent(cell: Column, parent_level: int) -> Column:
    """The coarser cell that holds the cell's centre."""
    centre = _bound(cell, lambda c: F.struct(*[v.alias(n) for v, n in zip(plane_centre(c), "xy")]))
    return _bound(centre, lambda p: plane_cell(p["x"], p["y"], parent_level))


def _shift(dq: int, dr: int) -> int:
    return dq * SPAN + dr


def ring_offsets(k: int) -> list[tuple[int, int]]:
    """Axial offsets at hexagonal distance exactly k."""
    return [
        (q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if max(abs(q), abs(r), abs(q + r)) == k
    ]


def cell_neighbours(cell: Column, max_ring: int = 1) -> Column:
    """Array of the cells within `max_ring` steps, the cell itself left out."""
    offsets = [o for k in range(1, max_ring + 1) for o in ring_offsets(k)]
    return F.array(*[cell + F.lit(_shift(q, r)).cast("bigint") for q, r in offsets])


def cell_corners(cell: Column) -> Column:
    """Array of 6 (lat, lon) corner structs."""
    x, y = plane_centre(cell)
    size = cell_edge(cell)
    corners = []
    for i in range(6):
        angle = math.radians(60 * i - 30)
        lat, lon = unmercator(x + size * math.cos(angle), y + size * math.sin(angle))
        corners.append(F.struct(lat.alias("lat"), lon.alias("lon")))
    return F.array(*corners)


def cell_edges(cell: Column) -> Column:
    """Array of 6 directed edges (start, end), counter-clockwise, by integer corner keys.

    A corner is keyed by the sum of the axial coordinates of the three cells that meet
    there, so neighbouring cells name a shared corner alike.
    """
    q, r = cell_parts(cell)
    # cells around corner i: the cell and the neighbours in directions i and i - 1
    around = {0: (0, 1), 1: (5, 0), 2: (4, 5), 3: (3, 4), 4: (2, 3), 5: (1, 2)}
    keys = []
    for i in range(6):
        a, b = (OFFSETS[j] for j in around[i])
        keys.append((q * 3 + (a[0] + b[0]), r * 3 + (a[1] + b[1])))
    structs = []
    for i in range(6):
        s, e = keys[i], keys[(i + 1) % 6]
        structs.append(F.struct(s[0].alias("q0"), s[1].alias("r0"), e[0].alias("q1"), e[1].alias("r1")))
    return F.array(*structs)


def corner_point(q3: Column, r3: Column, size: Column) -> tuple[Column, Column]:
    """(lat, lon) of a corner key, for cells of the given edge length: the mean of its three cell centres."""
    q, r = q3 / 3.0, r3 / 3.0
    return unmercator((q * SQRT3 + r * (SQRT3 / 2)) * size, r * (1.5 * size))
