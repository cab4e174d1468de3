"""Polygon operators on rings stored as ARRAY<STRUCT<lat, lon>>; no geometry library needed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexgrid import EARTH_RADIUS, cell_centre, cell_id, edge_length, mercator
from ..functions.scalars import minute_of_day
from .temporal import schedule_slots, week_slot

SCHEDULE_JSON = "array<struct<id:int,name:string,price:double,coords:array<array<string>>>>"


def rotated(ring: Column) -> Column:
    """The ring shifted by one point, to pair each point with the next."""
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray casting along the latitude of the point."""

    def crosses(a, b):
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) * F.try_divide(b["lon"] - a["lon"], b["lat"] - a["lat"])
        return F.when(straddles & (lon < at), 1).otherwise(0)

    hits = F.aggregate(F.zip_with(ring, rotated(ring), crosses), F.lit(0), lambda s, c: s + c)
    return hits % 2 == 1


def bounding_box(ring: Column) -> dict[str, Column]:
    lats, lons = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return {
        "lat_lo": F.array_min(lats), "lat_hi": F.array_max(lats), "lon_lo": F.array_min(lons), "lon_hi": F.array_max(lons)
    }


def _tile(v: Column, tile: float) -> Column:
    return F.floor(v / tile).cast("bigint")


FINE = 8  # fine tiles along each side of a tile


def _edge_meets(ring: Column, lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> Column:
    """Whether an edge of the ring meets the rectangle: boxes overlap and the corners are not all on one side of it."""

    def meets(e):
        a, b = e["a"], e["b"]
        overlap = (F.least(a["lat"], b["lat"]) <= lat_hi) & (F.greatest(a["lat"], b["lat"]) >= lat_lo) & (F.least(a["lon"], b["lon"]) <= lon_hi) & (F.greatest(a["lon"], b["lon"]) >= lon_lo)
        side = [(b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"]) for y in (lat_lo, lat_hi) for x in (lon_lo, lon_hi)]
        return overlap & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    edges = F.zip_with(ring, rotated(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(edges, meets)


def tile_cover(polygons: DataFrame, ring: str = "ring", tile: float = 0.05) -> DataFrame:
    """A row for each (polygon, tile it touches): `__tx`, `__ty`, `__whole` (the tile lies inside), `__inner` and `__edge`.

    A tile that an edge meets is cut into FINE x FINE fine tiles; `__inner` numbers those inside, `__edge` those that
    an edge meets. Only points of the latter need ray casting. Rectangles are widened a little for rounding.
    """
    box = {f"__{n}": c for n, c in bounding_box(F.col(ring)).items()}
    out = polygons.withColumns(box).withColumn("__tx", F.explode(F.sequence(_tile(F.col("__lat_lo"), tile), _tile(F.col("__lat_hi"), tile))))
    out = out.withColumn("__ty", F.explode(F.sequence(_tile(F.col("__lon_lo"), tile), _tile(F.col("__lon_hi"), tile)))).drop(*box)
    eps, fine = tile * 1e-9, tile / FINE
    met = lambda lat, lon, size: _edge_meets(F.col(ring), lat - eps, lat + size + eps, lon - eps, lon + size + eps)
    inside = lambda lat, lon, size: point_in_ring(lat + size / 2, lon + size / 2, F.col(ring))
    lat, lon = F.col("__tx") * tile, F.col("__ty") * tile
    out = out.withColumns({"__met": met(lat, lon, tile), "__whole": inside(lat, lon, tile)}).filter("__met OR __whole")
    corner = lambda k: (lat + F.floor(k / FINE) * fine, lon + (k % FINE) * fine)
    numbers = F.sequence(F.lit(0), F.lit(FINE * FINE - 1))
    out = out.withColumn("__edge", F.when(F.col("__met"), F.filter(numbers, lambda k: met(*corner(k), fine))).otherwise(F.array().cast("array<int>")))
    inner = F.filter(F.array_except(numbers, F.col("__edge")), lambda k: inside(*corner(k), fine))
    out = out.withColumn("__inner", F.when(F.col("__met"), inner).otherwise(F.array().cast("array<int>")))
    return out.withColumn("__whole", ~F.col("__met")).drop("__met").filter("__whole OR size(__edge) + size(__inner) > 0")


def _with_tiles(points: DataFrame, lat: str, lon: str, tile: float) -> DataFrame:
    """Adds the point's tile (`__px`, `__py`) and its fine tile's number in it (`__pf`)."""
    la, lo = F.col(lat), F.col(lon)
    points = points.withColumns({"__px": _tile(la, tile), "__py": _tile(lo, tile)})
    at = lambda v, t: F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.floor((v - F.col(t) * tile) / (tile / FINE))))
    return points.withColumn("__pf", (at(la, "__px") * FINE + at(lo, "__py")).cast("int"))


def polygon_join(
    points: DataFrame, polygons: DataFrame, lat: str = "lat", lon: str = "lon", ring: str = "ring",
    tile: float = 0.05, keys: Sequence[str] = (), how: str = "inner",
) -> DataFrame:
    """Point-in-polygon join: equi join on (keys, tile) with the polygons' tile cover; ray casting near outlines only.

    A point lies in one tile, so no row is multiplied before the join. A row comes out per (point, polygon that holds it).
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    return _cover_join(points, tile_cover(polygons, ring, tile), lat, lon, ring, tile, keys, how)


def _cover_join(points: DataFrame, cover: DataFrame, lat: str, lon: str, ring: str, tile: float, keys: Sequence[str], how: str) -> DataFrame:
    cover = cover.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = (F.col("__px") == F.col("__tx")) & (F.col("__py") == F.col("__ty"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    cast = F.array_contains("__edge", F.col("__pf")) & point_in_ring(F.col(lat), F.col(lon), F.col(ring))
    joined = _with_tiles(points, lat, lon, tile).join(cover, cond & (F.col("__whole") | F.array_contains("__inner", F.col("__pf")) | cast), how)
    return joined.drop(*[c for c in joined.columns if c.startswith("__")])


def in_any_polygon(
    points: DataFrame, polygons: DataFrame, name: str = "is_in", lat: str = "lat", lon: str = "lon", ring: str = "ring", tile: float = 0.05, keys: Sequence[str] = (),
) -> DataFrame:
    """Adds a flag: the point lies in at least one polygon. One join: a tile's row holds all polygons that touch it.

    Null coordinates give false. A tile's row grows with the outlines that cross the tile; choose `tile` to keep them few.
    """
    keys = list(keys)
    cover = tile_cover(polygons.select(*keys, ring), ring, tile)
    outline = F.when(F.size("__edge") > 0, F.struct(F.col("__edge").alias("edge"), F.col(ring).alias("ring")))
    tiles = cover.groupBy(*keys, "__tx", "__ty").agg(F.bool_or("__whole").alias("__whole"), F.array_distinct(F.flatten(F.collect_list("__inner"))).alias("__inner"), F.collect_list(outline).alias("__outlines"))
    tiles = tiles.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    cond = (F.col("__px") == F.col("__tx")) & (F.col("__py") == F.col("__ty"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__k_{k}"))
    joined = _with_tiles(points, lat, lon, tile).join(tiles, cond, "left")
    cast = F.exists("__outlines", lambda o: F.array_contains(o["edge"], F.col("__pf")) & point_in_ring(F.col(lat), F.col(lon), o["ring"]))
    flag = F.coalesce(F.col("__whole") | F.array_contains("__inner", F.col("__pf")) | cast, F.lit(False))
    return joined.withColumn(name, flag).select(*points.columns, name)


def scheduled_polygon_join(
    points: DataFrame, schedule: DataFrame, ts: str = "ts", keys: Sequence[str] = (), metres: float = 0.0, lat: str = "lat", lon: str = "lon", tile: float = 0.05,
) -> DataFrame:
    """Points inside the area and time of schedule rows (see `parse_schedule`): a row per (point, schedule row).

    One equi join on (keys, weekday and half hour, tile): the cover of each polygon is made once and handed to every
    half hour of its schedule; the exact times are tested on what meets. Adds `in_polygon` and, with `metres`,
    `in_buffer`: outside the polygon but within that distance of it.
    """
    area = schedule.withColumn("__area", widened_box(F.col("ring"), metres) if metres else F.col("ring"))
    slots = schedule_slots(tile_cover(area, "__area", tile))
    timed = points.withColumn("__slot", week_slot(ts))
    joined = _cover_join(timed, slots.withColumnsRenamed({"__from": "from_", "__until": "until_", "__area": "area_"}), lat, lon, "area_", tile, [*keys, "__slot"], "inner")
    joined = joined.filter((minute_of_day(ts) >= F.col("from_")) & (minute_of_day(ts) < F.col("until_"))).drop("from_", "until_", "area_")
    core = point_in_ring(F.col(lat), F.col(lon), F.col("ring"))
    joined = joined.withColumn("in_polygon", core if metres else F.lit(True))
    if not metres:
        return joined
    return joined.withColumn("in_buffer", in_surrounding_area(F.col(lat), F.col(lon), F.col("ring"), metres)).filter("in_polygon OR in_buffer")


def widened_box(ring: Column, metres: float) -> Column:
    """The bounding box of all points within `metres` of the ring (on the Mercator plane), as a ring."""
    box = bounding_box(ring)
    pad = math.degrees(metres / EARTH_RADIUS) * 1.01  # a degree of latitude is shorter on the plane than at the equator
    lo_a, hi_a, lo_o, hi_o = box["lat_lo"] - pad, box["lat_hi"] + pad, box["lon_lo"] - pad, box["lon_hi"] + pad
    return F.array(*[F.struct(a.alias("lat"), b.alias("lon")) for a, b in ((lo_a, lo_o), (hi_a, lo_o), (hi_a, hi_o), (lo_a, hi_o))])


def ring_distance(lat: Column, lon: Column, ring: Column) -> Column:
    """Distance in Mercator-plane metres from a point to the ring's nearest edge."""
    px, py = mercator(lat, lon)

    def to_edge(a, b):
        ax, ay = mercator(a["lat"], a["lon"])
        bx, by = mercator(b["lat"], b["lon"])
        dx, dy = bx - ax, by - ay
        t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(px - (ax + t * dx), py - (ay + t * dy))

    return F.array_min(F.zip_with(ring, rotated(ring), to_edge))


def in_surrounding_area(lat: Column, lon: Column, ring: Column, metres: float) -> Column:
    """Outside the polygon but within `metres` of it."""
    return ~point_in_ring(lat, lon, ring) & (ring_distance(lat, lon, ring) <= metres)


def ring_area(ring: Column) -> Column:
    """Area in square metres on the equal-area cylindrical projection, measured from the ring's first point: small rings keep their digits."""
    x, y = lambda p: F.radians(p["lon"]), lambda p: F.sin(F.radians(p["lat"]))
    origin = ring[0]

    def cross(a, b):
        return (x(a) - x(origin)) * (y(b) - y(origin)) - (x(b) - x(origin)) * (y(a) - y(origin))

    twice = F.aggregate(F.zip_with(ring, rotated(ring), cross), F.lit(0.0), lambda s, c: s + c)
    return F.abs(twice) / 2 * EARTH_RADIUS**2


def smoothed_ring(ring: Column, rounds: int = 2) -> Column:
    """Corner cutting: each edge gives its quarter points; the end points of the line stay."""

    def mix(a, b, w):
        return F.struct(
            (a["lat"] * w + b["lat"] * (1 - w)).alias("lat"), (a["lon"] * w + b["lon"] * (1 - w)).alias("lon")
        )

    for _ in range(rounds):
        edges = F.zip_with(
            F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
            lambda a, b: F.array(mix(a, b, 0.75), mix(a, b, 0.25)),
        )
        ring = F.concat(F.slice(ring, 1, 1), F.flatten(edges), F.slice(ring, -1, 1))
    return ring


DIGITS = 7  # decimals of written coordinates: about a centimetre


def _positions(ring: Column) -> Column:
    """The closed ring as [lon, lat] pairs."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.transform(closed, lambda p: F.array(F.round(p["lon"], DIGITS), F.round(p["lat"], DIGITS)))


def geojson(ring: Column) -> Column:
    """GeoJSON Polygon text; the ring is closed and (lat, lon) is swapped to (lon, lat)."""
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(_positions(ring)).alias("coordinates")))


def geojson_shapes(rings: Column) -> Column:
    """GeoJSON MultiPolygon text of an array of outer rings."""
    coords = F.transform(rings, lambda ring: F.array(_positions(ring)))
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))


def feature(ring: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(_positions(ring)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def parse_schedule(df: DataFrame, text: str = "polygons") -> DataFrame:
    """Schedule rows with polygon JSON to one row per (schedule row, polygon) with a ring column."""
    polys = df.filter(F.col("week_day").isNotNull()).withColumn("__p", F.explode(F.from_json(F.col(text), SCHEDULE_JSON)))
    ring = F.transform(
        F.col("__p.coords"),
        lambda c: F.struct(c[0].cast("double").alias("lat"), c[1].cast("double").alias("lon")),
    )
    return polys.select(
        *[c for c in df.columns if c != text], F.col("__p.id").alias("polygon_id"), F.col("__p.name").alias("polygon"),
        F.col("__p.price").alias("price"), ring.alias("ring"),
    )


def polygon_cells(polygons: DataFrame, keys: Sequence[str], ring: str = "ring", level: int = 8) -> DataFrame:
    """(keys, cell): the cells whose centre lies in the polygon.

    Rows of cells over the bounding box are exploded, then tested.
    """
    size = edge_length(level)
    box = {f"__{n}": c for n, c in bounding_box(F.col(ring)).items()}
    df = polygons.select(*keys, F.col(ring)).withColumns(box)
    x_lo, y_lo = mercator(F.col("__lat_lo"), F.col("__lon_lo"))
    x_hi, y_hi = mercator(F.col("__lat_hi"), F.col("__lon_hi"))
    df = df.withColumns({"__xl": x_lo, "__xh": x_hi, "__yl": y_lo, "__yh": y_hi})
    df = df.withColumn(
        "__r", F.explode(F.sequence(F.floor(F.col("__yl") / (1.5 * size)) - 1, F.ceil(F.col("__yh") / (1.5 * size)) + 1))
    )
    q_of = lambda x: x / (math.sqrt(3) * size) - F.col("__r") / 2
    df = df.withColumn(
        "__q", F.explode(F.sequence(F.floor(q_of(F.col("__xl"))) - 1, F.ceil(q_of(F.col("__xh"))) + 1))
    )
    df = df.withColumn("cell", cell_id(F.col("__q"), F.col("__r"), level))
    lat, lon = cell_centre(F.col("cell"))
    return df.filter(point_in_ring(lat, lon, F.col(ring))).select(*keys, "cell").distinct()


def overlap_share(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: str = "cell") -> DataFrame:
    """Share of each slot's active cells (a) covered by suggested cells (b); both unions of polygons."""
    left = a.select(*keys, cell).distinct().withColumn("__a", F.lit(1))
    right = b.select(*keys, cell).distinct().withColumn("__b", F.lit(1))
    both = left.join(right, [*keys, cell], "full_outer")
    return both.groupBy(*keys).agg(
        F.count("__a").alias("active_cells"), F.count("__b").alias("suggested_cells"),
        F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1)).alias("shared_cells"),
    ).withColumn("share", F.try_divide(F.col("shared_cells").cast("double"), F.col("active_cells").cast("double")))
