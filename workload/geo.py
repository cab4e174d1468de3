"""Hex, polygon, clustering and price-zone queries."""

import json
import math

from pyspark.sql import functions as F

from curbside.functions import hexgrid as H
from curbside.functions.frames import stable_checkpoint
from curbside.operators import geoclusters as G
from curbside.operators import polygons as P
from curbside.plans import geo_pricing as Z

from .base import LAT, LAT_SQL, LON, LON_SQL, query, r, rounded, table, tables

R0 = H.EARTH_RADIUS


def points(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "event_type", "value", F.expr(LAT).cast("double").alias("lat"), F.expr(LON).cast("double").alias("lon")
    )


PTS_SQL = f"pts AS (SELECT event_id, user_id, ts, event_type, value, ({LAT_SQL}) AS lat, ({LON_SQL}) AS lon FROM events)"


def pts_cells_sql(level=8):
    """pts plus axial coordinates and cell, in steps."""
    s = H.edge_length(level)
    return f"""{PTS_SQL},
f0 AS (SELECT *, (radians(lon)*{R0!r}*{math.sqrt(3)/3!r} - ln(tan(pi()/4 + radians(lat)/2))*{R0!r}/3)/{s!r} AS fq, ln(tan(pi()/4 + radians(lat)/2))*{R0!r}*{2/3!r}/{s!r} AS fr FROM pts),
f1 AS (SELECT *, round_even(fq, 0) AS q, round_even(fr, 0) AS r, round_even(-fq-fr, 0) AS s, round_even(abs(round_even(fq,0)-fq)*1e8, 0) AS dq, round_even(abs(round_even(fr,0)-fr)*1e8, 0) AS dr, round_even(abs(round_even(-fq-fr,0)-(-fq-fr))*1e8, 0) AS ds FROM f0),
cells AS (SELECT event_id, user_id, ts, event_type, value, lat, lon, (CASE WHEN dq > dr AND dq > ds THEN -r-s ELSE q END)::BIGINT AS q,
 (CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q-s ELSE r END)::BIGINT AS r FROM f1),
cid AS (SELECT *, {level}::BIGINT * {1 << 56} + (q + {H.HALF}) * {H.SPAN} + (r + {H.HALF}) AS cell FROM cells)"""


@query("points_to_hex_cells", f"""WITH {pts_cells_sql(8)}
SELECT cell, count(*) AS n, count(DISTINCT user_id) AS users FROM cid GROUP BY 1""")
def hex_cells(spark, sf):
    p = points(spark, sf).withColumn("cell", H.point_cell(F.col("lat"), F.col("lon"), 8))
    return p.groupBy("cell").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("parent_hex_cells", f"""WITH {pts_cells_sql(8)},
ctr AS (SELECT ({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3)/2!r}::DOUBLE*r)*{H.edge_length(8)!r} AS x, r*{1.5*H.edge_length(8)!r} AS y FROM cells),
g0 AS (SELECT (x*{math.sqrt(3)/3!r}::DOUBLE - y/3)/{H.edge_length(6)!r} AS fq, y*{2/3!r}::DOUBLE/{H.edge_length(6)!r}::DOUBLE AS fr FROM ctr),
g1 AS (SELECT *, round_even(fq,0) AS q, round_even(fr,0) AS r, round_even(-fq-fr,0) AS s, round_even(abs(round_even(fq,0)-fq)*1e8, 0) AS dq, round_even(abs(round_even(fr,0)-fr)*1e8, 0) AS dr, round_even(abs(round_even(-fq-fr,0)-(-fq-fr))*1e8, 0) AS ds FROM g0)
SELECT 6::BIGINT * {1 << 56} + ((CASE WHEN dq > dr AND dq > ds THEN -r-s ELSE q END)::BIGINT + {H.HALF}) * {H.SPAN} + ((CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q-s ELSE r END)::BIGINT + {H.HALF}) AS parent, count(*) AS n FROM g1 GROUP BY 1""")
def parents(spark, sf):
    cell = H.point_cell(F.col("lat"), F.col("lon"), 8)
    return points(spark, sf).groupBy(H.cell_parent(cell, 6).alias("parent")).agg(F.count("*").alias("n"))


@query("hex_cell_centres", f"""WITH {pts_cells_sql(8)}, d AS (SELECT DISTINCT cell, ({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3)/2!r}::DOUBLE*r)*{H.edge_length(8)!r} AS x, r*{1.5*H.edge_length(8)!r} AS y FROM cid)
SELECT cell, round(degrees(2*atan(exp(y/{R0!r})) - pi()/2), 7) AS lat, round(degrees(x/{R0!r}), 7) AS lon FROM d""")
def centres(spark, sf):
    cells = points(spark, sf).select(H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    return rounded(G.with_centres(cells), 7)


def hex_rings_sql(level=8):
    """CTEs after `pts_cells_sql`: busy (cell, n, q, r), six corners `co` of each, and `rings` with the written positions and the area."""
    e = H.edge_length(level)
    return f"""busy AS (SELECT cell, any_value(q) AS q, any_value(r) AS r, count(*) AS n FROM cid GROUP BY 1),
xy AS (SELECT cell, i, ({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3) / 2!r}::DOUBLE*r)*{e!r} + {e!r}*cos(radians(60.0*i - 30)) AS x, r*{1.5 * e!r} + {e!r}*sin(radians(60.0*i - 30)) AS y FROM busy, (SELECT unnest(range(0, 6)) AS i)),
co AS (SELECT cell, i, degrees(2*atan(exp(y/{R0!r})) - pi()/2) AS lat, degrees(x/{R0!r}) AS lon FROM xy),
pt AS (SELECT *, '[' || round(lon, 7)::DOUBLE || ',' || round(lat, 7)::DOUBLE || ']' AS pos, radians(lon) - radians(first_value(lon) OVER w) AS px, sin(radians(lat)) - sin(radians(first_value(lat) OVER w)) AS py FROM co WINDOW w AS (PARTITION BY cell ORDER BY i)),
nx AS (SELECT a.cell, a.i, a.pos, a.px * b.py - b.px * a.py AS c FROM pt a JOIN pt b ON a.cell = b.cell AND b.i = (a.i + 1) % 6),
rings AS (SELECT cell, string_agg(pos, ',' ORDER BY i) || ',' || first(pos ORDER BY i) AS positions, abs(sum(c)) / 2 * {R0**2!r} AS area FROM nx GROUP BY 1)"""


@query("hex_cell_boundaries", f"""WITH {pts_cells_sql(8)}, {hex_rings_sql()}
SELECT cell, '{{"type":"Polygon","coordinates":[[' || positions || ']]}}' AS polygon, round(area, 2) AS area FROM rings""")
def boundaries(spark, sf):
    """Six corners per cell as GeoJSON, and the cell's area."""
    cells = points(spark, sf).select(H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    ring = cells.select("cell", H.cell_corners(F.col("cell")).alias("ring"))
    return ring.select("cell", P.geojson(F.col("ring")).alias("polygon"), r(P.ring_area(F.col("ring")), 2).alias("area"))


@query("hex_neighbour_counts", f"""WITH {pts_cells_sql(8)}, d AS (SELECT DISTINCT q, r, cell FROM cid),
o(dq, dr) AS (VALUES (1,0),(1,-1),(0,-1),(-1,0),(-1,1),(0,1))
SELECT d.cell, count(e.cell) AS neighbours FROM d, o LEFT JOIN d e ON e.q = d.q + dq AND e.r = d.r + dr GROUP BY 1 HAVING count(e.cell) > 0""")
def neighbour_counts(spark, sf):
    cells = points(spark, sf).select(H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    return G.neighbour_links(cells, []).groupBy("cell").agg(F.count("*").alias("neighbours"))


@query("cluster_radius_per_slot", f"""WITH {pts_cells_sql(8)}, d AS (SELECT DISTINCT isodow(ts) - 1 AS weekday, q, r FROM cells), o(dq, dr) AS (VALUES (0,0),(1,0),(1,-1),(0,-1),(-1,0),(-1,1),(0,1)),
c AS (SELECT weekday, q, r, dq, dr, degrees(2*atan(exp((r+dr)*{1.5*H.edge_length(8)!r}/{R0!r})) - pi()/2) AS lat, degrees(({math.sqrt(3)!r}::DOUBLE*(q+dq) + {math.sqrt(3)/2!r}::DOUBLE*(r+dr))*{H.edge_length(8)!r}/{R0!r}) AS lon FROM d, o),
w AS (SELECT a.weekday, max(sqrt(pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2))) AS w FROM c a JOIN c b USING (weekday, q, r) WHERE a.dq = 0 AND a.dr = 0 GROUP BY a.weekday, a.q, a.r)
SELECT weekday::INT AS weekday, round(0.2 * avg(w) + 0.8 * max(w), 9) AS eps FROM w GROUP BY 1""")
def radius(spark, sf):
    cells = points(spark, sf).select(F.weekday("ts").alias("weekday"), H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    return rounded(G.cluster_radius(cells, ["weekday"]), 9)


_ZONES = [
    (1, "north", [(55.53, 37.31), (55.57, 37.31), (55.57, 37.36), (55.53, 37.36)]),
    (2, "triangle", [(55.50, 37.30), (55.56, 37.33), (55.50, 37.38)]),
    (3, "concave", [(55.55, 37.34), (55.60, 37.34), (55.57, 37.36), (55.60, 37.40), (55.55, 37.40)]),
]


def zones(spark):
    rows = [(i, n, [{"lat": a, "lon": b} for a, b in ring]) for i, n, ring in _ZONES]
    return spark.createDataFrame(rows, "zone_id int, zone string, ring array<struct<lat:double,lon:double>>")


def _edges_sql():
    rows = []
    for i, n, ring in _ZONES:
        for k, (a, b) in enumerate(ring):
            c, d = ring[(k + 1) % len(ring)]
            rows.append(f"({i}, '{n}', {a}, {b}, {c}, {d})")
    return "edges(zone_id, zone, a_lat, a_lon, b_lat, b_lon) AS (SELECT col0, col1, col2::DOUBLE, col3::DOUBLE, col4::DOUBLE, col5::DOUBLE FROM (VALUES " + ", ".join(rows) + "))"


INSIDE_SQL = f"""{PTS_SQL}, {_edges_sql()},
inside AS (SELECT event_id, any_value(user_id) AS user_id, zone_id, any_value(zone) AS zone FROM pts JOIN edges ON (a_lat > lat) <> (b_lat > lat) AND lon < a_lon + (lat - a_lat) * (b_lon - a_lon) / (b_lat - a_lat)
 GROUP BY event_id, zone_id HAVING count(*) % 2 = 1)"""


@query("point_in_polygon_join", f"""WITH {INSIDE_SQL} SELECT zone, count(*) AS n, count(DISTINCT user_id) AS users FROM inside GROUP BY 1""")
def pip(spark, sf):
    hit = P.polygon_join(points(spark, sf), zones(spark), tile=0.02)
    return hit.groupBy("zone").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("point_in_any_polygon_flag", f"""WITH {INSIDE_SQL} SELECT (i.event_id IS NOT NULL)::INT AS is_in, count(*) AS n FROM pts LEFT JOIN (SELECT DISTINCT event_id FROM inside) i USING (event_id) GROUP BY 1""")
def any_polygon(spark, sf):
    flagged = P.in_any_polygon(points(spark, sf), zones(spark), tile=0.02)
    return flagged.groupBy(F.col("is_in").cast("int").alias("is_in")).agg(F.count("*").alias("n"))


@query("surrounding_area_points", f"""WITH {INSIDE_SQL},
m AS (SELECT zone_id, zone, radians(a_lon)*{R0!r} AS ax, ln(tan(pi()/4+radians(a_lat)/2))*{R0!r} AS ay, radians(b_lon)*{R0!r} AS bx, ln(tan(pi()/4+radians(b_lat)/2))*{R0!r} AS by_ FROM edges),
p AS (SELECT event_id, radians(lon)*{R0!r} AS px, ln(tan(pi()/4+radians(lat)/2))*{R0!r} AS py FROM pts),
t AS (SELECT event_id, zone_id, zone, px, py, ax, ay, bx-ax AS dx, by_-ay AS dy, greatest(0, least(1, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS u FROM p, m),
d AS (SELECT event_id, zone_id, any_value(zone) AS zone, min(sqrt(pow(px-ax-u*dx,2)+pow(py-ay-u*dy,2))) AS dist FROM t GROUP BY 1, 2)
SELECT d.zone, count(*) AS n FROM d LEFT JOIN inside i ON i.event_id = d.event_id AND i.zone_id = d.zone_id WHERE i.event_id IS NULL AND dist <= 1000 GROUP BY 1""")
def surrounding(spark, sf):
    # each zone's box is widened by the buffer, so the tile join still finds the candidates
    pad_lat, pad_lon = 1000 / 111000.0 * 1.2, 1000 / 111000.0 * 1.2
    z = zones(spark).withColumn("core", F.col("ring"))
    box = P.bounding_box(F.col("core"))
    corner = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    lo_a, hi_a, lo_o, hi_o = box["lat_lo"] - pad_lat, box["lat_hi"] + pad_lat, box["lon_lo"] - pad_lon, box["lon_hi"] + pad_lon
    z = z.withColumn("ring", F.array(corner(lo_a, lo_o), corner(hi_a, lo_o), corner(hi_a, hi_o), corner(lo_a, hi_o)))
    near = P.polygon_join(points(spark, sf), z, tile=0.02)
    return near.filter(P.in_surrounding_area(F.col("lat"), F.col("lon"), F.col("core"), 1000.0)).groupBy("zone").agg(F.count("*").alias("n"))


@query("reprojected_points", f"""WITH {PTS_SQL} SELECT p.event_id, round(radians(p.lon)*{R0!r}, 4) AS x, round(ln(tan(pi()/4+radians(p.lat)/2))*{R0!r}, 4) AS y, round(p.lat, 8) AS lat FROM pts p""")
def reprojected(spark, sf):
    x, y = H.mercator(F.col("lat"), F.col("lon"))
    back, _ = H.unmercator(x, y)
    return points(spark, sf).select("event_id", r(x, 4).alias("x"), r(y, 4).alias("y"), r(back, 8).alias("lat"))


@query("polygon_areas_by_points", f"""WITH {INSIDE_SQL},
z AS (SELECT *, radians(min(a_lon) OVER (PARTITION BY zone)) AS x0, sin(radians(min(a_lat) OVER (PARTITION BY zone))) AS y0 FROM edges),
a AS (SELECT zone, abs(sum((radians(a_lon)-x0)*(sin(radians(b_lat))-y0) - (radians(b_lon)-x0)*(sin(radians(a_lat))-y0)))/2*{R0**2!r} AS area FROM z GROUP BY 1)
SELECT i.zone, round(any_value(area), 2) AS area, round(count(*) / any_value(area) * 1e6, 6) AS events_per_km2 FROM inside i JOIN a USING (zone) GROUP BY 1""")
def areas(spark, sf):
    hit = P.polygon_join(points(spark, sf), zones(spark), tile=0.02)
    per = hit.groupBy("zone", "zone_id").agg(F.count("*").alias("n")).join(zones(spark).select("zone_id", P.ring_area(F.col("ring")).alias("area")), "zone_id")
    return per.select("zone", r("area", 2).alias("area"), r(F.col("n") / F.col("area") * 1e6).alias("events_per_km2"))


@query("polygon_filled_with_cells", f"""WITH {_edges_sql()}, {pts_cells_sql(8)}, d AS (SELECT DISTINCT cell, q, r FROM cid),
c AS (SELECT cell, degrees(2*atan(exp(r*{1.5*H.edge_length(8)!r}/{R0!r})) - pi()/2) AS lat, degrees(({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3)/2!r}::DOUBLE*r)*{H.edge_length(8)!r}/{R0!r}) AS lon FROM d),
i AS (SELECT zone_id, zone, cell FROM c JOIN edges ON (a_lat > lat) <> (b_lat > lat) AND lon < a_lon + (lat - a_lat) * (b_lon - a_lon) / (b_lat - a_lat) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)
SELECT zone, count(*) AS busy_cells FROM i GROUP BY 1""")
def filled(spark, sf):
    busy = points(spark, sf).select(H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    cells = P.polygon_cells(zones(spark), ["zone"])
    return cells.join(busy, "cell").groupBy("zone").agg(F.count("*").alias("busy_cells"))


def _cut_corners_sql(points_, out):
    """CTE `out` with the quarter points of each edge of the open lines in `points_` (zone_id, k, lat, lon); their ends stay."""
    mix = lambda w: ", ".join(f"a.{c} * {w}::DOUBLE + b.{c} * {1 - w}::DOUBLE" for c in ("lat", "lon"))
    return f"""{out} AS (SELECT zone_id, row_number() OVER (PARTITION BY zone_id ORDER BY o) - 1 AS k, lat, lon FROM (
 SELECT a.zone_id, 2 * a.k + 1 AS o, {mix(0.75)} FROM {points_} a JOIN {points_} b ON a.zone_id = b.zone_id AND b.k = a.k + 1
 UNION ALL SELECT a.zone_id, 2 * a.k + 2, {mix(0.25)} FROM {points_} a JOIN {points_} b ON a.zone_id = b.zone_id AND b.k = a.k + 1
 UNION ALL SELECT zone_id, 0, lat, lon FROM {points_} WHERE k = 0 UNION ALL SELECT zone_id, 2 * k + 9, lat, lon FROM {points_} a WHERE k = (SELECT max(k) FROM {points_} b WHERE a.zone_id = b.zone_id)) t(zone_id, o, lat, lon))"""


_POINTS_SQL = "z0 AS (SELECT col0 AS zone_id, col1 AS k, col2::DOUBLE AS lat, col3::DOUBLE AS lon FROM (VALUES " + ", ".join(f"({i}, {k}, {a}, {b})" for i, _, ring in _ZONES for k, (a, b) in enumerate(ring)) + "))"


@query("smoothed_zone_geojson", f"""WITH {INSIDE_SQL}, h AS (SELECT zone_id, any_value(zone) AS zone, count(*) AS n FROM inside GROUP BY 1), {_POINTS_SQL}, {_cut_corners_sql('z0', 'z1')}, {_cut_corners_sql('z1', 'z2')},
s AS (SELECT zone_id, count(*)::INT AS points, string_agg('[' || round(lon, 7)::DOUBLE || ',' || round(lat, 7)::DOUBLE || ']', ',' ORDER BY k) AS positions, first('[' || round(lon, 7)::DOUBLE || ',' || round(lat, 7)::DOUBLE || ']' ORDER BY k) AS start FROM z2 GROUP BY 1)
SELECT zone, n, points, '{{"type":"Feature","properties":{{"zone_id":' || zone_id || ',"zone":"' || zone || '"}},"geometry":{{"type":"Polygon","coordinates":[[' || positions || ',' || start || ']]}}}}' AS feature FROM s JOIN h USING (zone_id)""")
def smoothed(spark, sf):
    """Zones that hold events, with corner-cut outlines."""
    hit = P.polygon_join(points(spark, sf), zones(spark), tile=0.02).groupBy("zone_id").agg(F.count("*").alias("n"))
    z = zones(spark).join(hit, "zone_id")
    ring = P.smoothed_ring(F.col("ring"), 2)
    return z.select("zone", "n", F.size(ring).alias("points"), P.feature(ring, F.struct("zone_id", "zone")).alias("feature"))


_POLYGONS = {
    "a": (1, 150, [(55.53, 37.31), (55.57, 37.31), (55.57, 37.36), (55.53, 37.36)]),
    "b": (2, 90, [(55.50, 37.30), (55.56, 37.33), (55.50, 37.38)]),
    "c": (3, 80, [(55.58, 37.30), (55.60, 37.30), (55.60, 37.40), (55.58, 37.40)]),
    "d": (4, 70, [(55.55, 37.34), (55.60, 37.34), (55.57, 37.36), (55.60, 37.40), (55.55, 37.40)]),
}
# campaign, locality modulo 5, weekday, from, until, polygons
_PLAN = [
    (7, 0, 1, 8, 0, 20, 0, "a"), (7, 0, 3, 0, 0, 24, 0, "bc"), (7, 1, 5, 6, 10, 6, 55, "abcd"), (9, 2, 6, 17, 45, 24, 0, "bd"), (9, 3, 7, 0, 0, 0, 1, "ac"), (8, 4, None, 0, 0, 24, 0, ""),
    (10, 4, 2, 9, 0, 18, 30, "d"), (10, 4, 2, 18, 0, 21, 15, "cd"), (11, 1, 4, 0, 0, 24, 0, "abd"),
]


def _polygon_json(names):
    return json.dumps([{"id": i, "name": n, "price": p, "coords": [[str(a), str(b)] for a, b in ring]} for n, (i, p, ring) in _POLYGONS.items() if n in names])


def json_schedule(spark):
    """Schedule rows with polygons as JSON text, for every locality of `offers`."""
    rows = [(c, loc, *rest, _polygon_json(names)) for c, m, *rest, names in _PLAN for loc in range(m, 25, 5)]
    return spark.createDataFrame(
        rows, "campaign_id int, id_locality bigint, week_day int, from_hour int, from_minute int, until_hour int, until_minute int, polygons string"
    )


def _plan_sql():
    edges, plan = [], []
    for n, (_, price, ring) in _POLYGONS.items():
        edges += [f"('{n}', {price}, {a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])]
    for c, m, wd, fh, fm, uh, um, names in _PLAN:
        plan += [f"({c}, {m}, {wd}, {fh * 60 + fm}, {uh * 60 + um}, '{n}')" for n in names if wd is not None]
    return f"""edges AS (SELECT col0 AS polygon, col1::DOUBLE AS price, col2::DOUBLE AS a_lat, col3::DOUBLE AS a_lon, col4::DOUBLE AS b_lat, col5::DOUBLE AS b_lon FROM (VALUES {', '.join(edges)})),
plan AS (SELECT col0 AS campaign_id, col1 AS m, col2 AS week_day, col3 AS f, col4 AS u, col5 AS polygon, row_number() OVER () AS plan_id FROM (VALUES {', '.join(plan)}))"""


def _timed_sql(frame="pts"):
    """CTE timed: rows of `frame` (event_id, user_id, ts, lat, lon) at each plan row of their locality and time, with `inside`."""
    return f"""{_plan_sql()}, timed0 AS (SELECT p.*, campaign_id, week_day, plan_id, polygon FROM {frame} p JOIN plan ON (user_id % 25) % 5 = m AND isodow(ts) = week_day AND hour(ts) * 60 + minute(ts) >= f AND hour(ts) * 60 + minute(ts) < u),
ins AS (SELECT event_id, plan_id, any_value(price) AS price, count(*) FILTER ((a_lat > lat) <> (b_lat > lat) AND lon < a_lon + (lat - a_lat) * (b_lon - a_lon) / nullif(b_lat - a_lat, 0)) % 2 = 1 AS inside FROM timed0 JOIN edges USING (polygon) GROUP BY 1, 2),
timed AS (SELECT * FROM timed0 JOIN ins USING (event_id, plan_id))"""


@query("scheduled_polygon_offers", f"""WITH {PTS_SQL}, {_timed_sql()}
SELECT campaign_id::INT AS campaign_id, week_day::INT AS week_day, polygon, count(*) AS offers, count(DISTINCT user_id) AS drivers, max(price) AS price FROM timed WHERE inside GROUP BY 1, 2, 3""")
def scheduled_polygons(spark, sf):
    """Schedule JSON parsed to polygons, joined by locality, half hour of the week and tile."""
    pts = points(spark, sf).withColumn("id_locality", F.col("user_id") % 25)
    hit = P.scheduled_polygon_join(pts, P.parse_schedule(json_schedule(spark)), keys=["id_locality"], tile=0.02)
    return hit.groupBy("campaign_id", "week_day", "polygon").agg(F.count("*").alias("offers"), F.countDistinct("user_id").alias("drivers"), F.max("price").alias("price"))


_DIST = f"""mer AS (SELECT polygon, radians(a_lon)*{R0!r} AS ax, ln(tan(pi()/4+radians(a_lat)/2))*{R0!r} AS ay, radians(b_lon)*{R0!r} AS bx, ln(tan(pi()/4+radians(b_lat)/2))*{R0!r} AS by_ FROM edges),
pm AS (SELECT event_id, plan_id, polygon, radians(lon)*{R0!r} AS px, ln(tan(pi()/4+radians(lat)/2))*{R0!r} AS py FROM timed),
t AS (SELECT event_id, plan_id, px, py, ax, ay, bx-ax AS dx, by_-ay AS dy, greatest(0, least(1, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS u FROM pm JOIN mer USING (polygon)),
d AS (SELECT event_id, plan_id, min(sqrt(pow(px-ax-u*dx,2)+pow(py-ay-u*dy,2))) AS dist FROM t GROUP BY 1, 2)"""


@query("scheduled_buffer_offers", f"""WITH {PTS_SQL}, {_timed_sql()}, {_DIST}
SELECT campaign_id::INT AS campaign_id, polygon, count(*) FILTER (inside) AS in_polygon, count(*) FILTER (NOT inside AND dist <= 800) AS in_buffer FROM timed JOIN d USING (event_id, plan_id) WHERE inside OR dist <= 800 GROUP BY 1, 2""")
def scheduled_buffers(spark, sf):
    """Offers in the schedule's polygons and in the 800 m around them."""
    pts = points(spark, sf).withColumn("id_locality", F.col("user_id") % 25)
    hit = P.scheduled_polygon_join(pts, P.parse_schedule(json_schedule(spark)), keys=["id_locality"], metres=800.0, tile=0.02)
    return hit.groupBy("campaign_id", "polygon").agg(F.count_if("in_polygon").alias("in_polygon"), F.count_if("in_buffer").alias("in_buffer"))


def _zone_cells_sql(level=8):
    """CTE zc: (q, r) of all cells whose centre lies in a zone."""
    s, points_ = H.edge_length(level), [p for _, _, ring in _ZONES for p in ring]
    y = [math.log(math.tan(math.pi / 4 + math.radians(a) / 2)) * R0 for a, _ in points_]
    x = [math.radians(b) * R0 for _, b in points_]
    lo, hi = math.floor(min(y) / (1.5 * s)) - 1, math.ceil(max(y) / (1.5 * s)) + 1
    first, last = math.floor(min(x) / (math.sqrt(3) * s) - hi / 2) - 1, math.ceil(max(x) / (math.sqrt(3) * s) - lo / 2) + 1
    return f"""grid AS (SELECT q, r, degrees(2*atan(exp(r*{1.5 * s!r}/{R0!r})) - pi()/2) AS lat, degrees(({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3) / 2!r}::DOUBLE*r)*{s!r}/{R0!r}) AS lon
 FROM (SELECT unnest(range({lo}, {hi + 1})) AS r), (SELECT unnest(range({first}, {last + 1})) AS q)),
zc AS (SELECT DISTINCT q, r FROM (SELECT q, r, zone_id FROM grid JOIN edges ON (a_lat > lat) <> (b_lat > lat) AND lon < a_lon + (lat - a_lat) * (b_lon - a_lon) / (b_lat - a_lat) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1))"""


@query("slot_polygon_overlap", f"""WITH {_edges_sql()}, {pts_cells_sql(8)}, {_zone_cells_sql()}, b AS (SELECT DISTINCT isodow(ts) - 1 AS weekday, q, r FROM cells),
a AS (SELECT weekday, count(*) AS active_cells, count(zc.q) AS shared_cells FROM b LEFT JOIN zc USING (q, r) GROUP BY 1)
SELECT weekday::INT AS weekday, active_cells, (SELECT count(*) FROM zc) AS suggested_cells, shared_cells, round(shared_cells / active_cells::DOUBLE, 6) AS share FROM a""")
def slot_overlap(spark, sf):
    """Share of each weekday's busy cells covered by the zones."""
    busy = points(spark, sf).select(F.weekday("ts").alias("weekday"), H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    days = busy.select("weekday").distinct()
    covered = P.polygon_cells(zones(spark), ["zone"]).withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return rounded(P.overlap_share(busy, covered.join(days, "weekday"), ["weekday"]))


@query("weekday_half_hour_matrix", """
SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%H:%M') AS slot, count(*) FILTER (isodow(ts)=1) AS "1", count(*) FILTER (isodow(ts)=2) AS "2", count(*) FILTER (isodow(ts)=3) AS "3",
count(*) FILTER (isodow(ts)=4) AS "4", count(*) FILTER (isodow(ts)=5) AS "5", count(*) FILTER (isodow(ts)=6) AS "6", count(*) FILTER (isodow(ts)=7) AS "7" FROM events GROUP BY 1""")
def matrix(spark, sf):
    from curbside.functions.scalars import iso_weekday, slot_start

    ev = table(spark, sf, "events").select(F.date_format(slot_start("ts", 30), "HH:mm").alias("slot"), iso_weekday("ts").alias("wd"))
    return ev.groupBy("slot").pivot("wd", [1, 2, 3, 4, 5, 6, 7]).count().fillna(0)


@query("cell_drivers_to_views", f"""WITH {pts_cells_sql(8)},
s AS (SELECT cell, time_bucket(INTERVAL 30 MINUTE, ts) AS slot, count(DISTINCT user_id) AS drivers, count(*) FILTER (event_type IN ('view','click')) AS views FROM cid GROUP BY 1, 2)
SELECT cell, sum(views)::BIGINT AS views, max(drivers) AS max_drivers, round(sum(drivers) / nullif(sum(views), 0)::DOUBLE, 6) AS d2v FROM s GROUP BY 1""")
def d2v(spark, sf):
    from curbside.functions.scalars import safe_ratio, slot_start
    from curbside.operators.metrics import Agg, aggregate

    p = points(spark, sf).select("user_id", "event_type", slot_start("ts", 30).alias("slot"), H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell"))
    s = aggregate(p, ["cell", "slot"], {"drivers": Agg("user_id", "nunique"), "views": Agg("*", "count", ("event_type in ('view', 'click')",))})
    return s.groupBy("cell").agg(
        F.sum("views").alias("views"), F.max("drivers").alias("max_drivers"), r(safe_ratio(F.sum("drivers"), F.sum("views"))).alias("d2v")
    )


def hex_cells_frame(spark, sf, p=None, level=7):
    """Hex dataset by (locality, weekday, half day, cell): demand, rides and bills from the events."""
    from curbside.functions.scalars import safe_ratio

    p = points(spark, sf).withColumn("locality", F.lit(1)) if p is None else p
    p = p.withColumns({"weekday": F.weekday("ts"), "hour": (F.floor(F.hour("ts") / 12) * 12).cast("int"), "cell": H.point_cell(F.col("lat"), F.col("lon"), level)})
    keys = [*Z.SLOT, "cell"]
    demand = p.groupBy(*keys).agg(F.count("*").alias("views"), safe_ratio(F.count_if(F.col("event_type") == "signup"), F.count("*")).alias("d2v"))
    rides = p.groupBy(*keys).agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("orders"), F.count_if(F.col("event_type") != "error").alias("rides"))
    bills = p.filter("event_type = 'purchase'").groupBy(*keys).agg(F.avg("value").alias("bill"))
    return Z.check_cells(Z.hex_dataset(demand, rides, bills))


@query("hot_cells_by_quantiles", f"""WITH {pts_cells_sql(8)},
g AS (SELECT isodow(ts) AS wd, cell, count(*) AS views, count(*) FILTER (event_type='signup') / count(*)::DOUBLE AS d2v FROM cid GROUP BY 1, 2),
t AS (SELECT *, quantile_cont(views, 0.6) OVER (PARTITION BY wd) AS tv, quantile_cont(d2v, 0.5) OVER (PARTITION BY wd) AS td FROM g)
SELECT wd::INT AS weekday, cell, views, round(d2v, 6) AS d2v FROM t WHERE views >= tv AND d2v <= td""")
def hot(spark, sf):
    p = points(spark, sf).withColumn("cell", H.point_cell(F.col("lat"), F.col("lon"), 8))
    g = p.groupBy((F.weekday("ts") + 1).alias("weekday"), "cell").agg(
        F.count("*").alias("views"), (F.count_if(F.col("event_type") == "signup") / F.count("*")).alias("d2v")
    )
    return rounded(G.hot_cells(g, ["weekday"], 0.6, 0.5))


@query("cells_with_real_rides", f"""WITH {pts_cells_sql(8)}, g AS (SELECT isodow(ts)::INT AS weekday, cell, count(*) AS n, count(*) FILTER (event_type='purchase') AS rides FROM cid GROUP BY 1, 2)
SELECT weekday, cell, n, rides FROM g WHERE cell IN (SELECT cell FROM g WHERE rides >= 2)""")
def with_rides(spark, sf):
    p = points(spark, sf).withColumn("cell", H.point_cell(F.col("lat"), F.col("lon"), 8))
    g = p.groupBy((F.weekday("ts") + 1).alias("weekday"), "cell").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("rides"))
    return G.cells_with_rides(g, [])


@query("clustered_price_zones")
def price_zones(spark, sf):
    """The whole zone pipeline at one quantile; tests check its parts by brute force."""
    limits = Z.CityLimits(views_quantile=0.5, d2v_default=0.8, d2v_min=0.5, d2v_max=0.95)
    return Z.suggest_prices(stable_checkpoint(hex_cells_frame(spark, sf)), limits, 0.8)


@query("budget_constrained_zones")
def budget(spark, sf):
    """Two cities, each with a limit of half of what its widest quantile would spend: one bisection for both on the d2v
    quantile, then the totals of their zones."""
    p = points(spark, sf).withColumn("locality", (F.col("user_id") % 97 >= 48).cast("int"))
    cells = stable_checkpoint(hex_cells_frame(spark, sf, p))
    limits = Z.CityLimits(views_quantile=0.5, d2v_min=0.5, d2v_default=0.7, d2v_max=0.95)
    cities = cells.select("locality").distinct().withColumn("node", F.lit(1))
    widest = Z.spend_by_city(cells, cities.withColumn("q", F.lit(limits.d2v_max)), limits)
    found = Z.search_cities(lambda c: Z.spend_by_city(cells, c, limits), widest.select("locality", (F.col("spend") / 2).alias("limit")), limits)
    costs = Z.zone_costs_by_city(cells, found.select("locality", F.lit(1).alias("node"), "q"), limits).filter("price > 0")
    return rounded(Z.setup_summary(costs).withColumnRenamed("spend", "zone_spend").join(found, "locality"), 4)


# --- price zones step by step: every hour of the week, two localities, level 8 ------------

def zone_cells(spark, sf):
    """Hex dataset by (locality, weekday, hour, cell): demand, rides and bills from the events; localities split by latitude."""
    from curbside.functions.scalars import safe_ratio

    p = points(spark, sf).withColumns({
        "locality": (F.col("user_id") % 97 >= 48).cast("int"), "weekday": F.weekday("ts"), "hour": F.hour("ts"), "cell": H.point_cell(F.col("lat"), F.col("lon"), 8),
    })
    keys = [*Z.SLOT, "cell"]
    demand = p.groupBy(*keys).agg(F.count("*").alias("views"), safe_ratio(F.count_if(F.col("event_type") == "signup"), F.count("*")).alias("d2v"))
    rides = p.groupBy(*keys).agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("orders"), F.count_if(F.col("event_type") != "error").alias("rides"))
    bills = p.filter("event_type = 'purchase'").groupBy(*keys).agg(F.avg("value").alias("bill"))
    return stable_checkpoint(Z.check_cells(Z.hex_dataset(demand, rides, bills)))


def hot_zone_cells(cells):
    hot = G.hot_cells(cells, ["locality", "weekday"], 0.2, 0.9)
    return stable_checkpoint(G.slots_with(G.cells_with_rides(hot, ["locality"], at_least=1), list(Z.SLOT)))


def clean_zone_cells(cells):
    slot, label = list(Z.SLOT), ["geo_cluster"]
    df = stable_checkpoint(G.geo_clusters(hot_zone_cells(cells), slot))
    df = stable_checkpoint(G.slots_with(G.drop_isolated(df, slot, label, 1), slot))
    df = stable_checkpoint(G.fill_holes(df, cells, slot, label, 3))
    return stable_checkpoint(G.recolour_by_neighbours(df, slot, label, 3))


_S8 = H.edge_length(8)
_AROUND = "o(dq, dr) AS (VALUES (1,0),(1,-1),(0,-1),(-1,0),(-1,1),(0,1))"
_HOT_SQL = f"""{pts_cells_sql(8)}, {_AROUND},
base AS (SELECT (user_id % 97 >= 48)::INT AS locality, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, q, r, count(*) AS views, count(*) FILTER (event_type = 'signup') / count(*)::DOUBLE AS d2v,
 count(*) FILTER (event_type IN ('click', 'purchase')) AS orders, count(*) FILTER (event_type <> 'error') AS rides, coalesce(avg(value) FILTER (event_type = 'purchase'), 0) AS bill FROM cells GROUP BY ALL),
th AS (SELECT locality, weekday, quantile_cont(views, 0.2) AS tv, quantile_cont(d2v, 0.9) AS td FROM base GROUP BY 1, 2),
h0 AS (SELECT base.* FROM base JOIN th USING (locality, weekday) WHERE views >= tv AND d2v <= td),
h1 AS (SELECT * FROM h0 WHERE (locality, q, r) IN (SELECT locality, q, r FROM h0 WHERE rides >= 1)),
hot AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY locality, weekday, hour) AS slot, degrees(2*atan(exp(r*{1.5 * _S8!r}/{R0!r})) - pi()/2) AS lat, degrees(({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3) / 2!r}::DOUBLE*r)*{_S8!r}/{R0!r}) AS lon
 FROM h1 QUALIFY count(*) OVER (PARTITION BY locality, weekday, hour) >= 3)"""
_CLUSTER_SQL = f"""{_HOT_SQL},
wi AS (SELECT slot, h.q, h.r, max(sqrt(pow(degrees(2*atan(exp((h.r+dr)*{1.5 * _S8!r}/{R0!r})) - pi()/2) - lat, 2) + pow(degrees(({math.sqrt(3)!r}::DOUBLE*(h.q+dq) + {math.sqrt(3) / 2!r}::DOUBLE*(h.r+dr))*{_S8!r}/{R0!r}) - lon, 2))) AS w FROM hot h, o GROUP BY 1, 2, 3),
ep AS (SELECT slot, (0.2 * avg(w) + 0.8 * max(w)) * (1 + 1e-9) AS eps FROM wi GROUP BY 1),
id AS MATERIALIZED (SELECT *, {8 * (1 << 56)}::BIGINT + (q + {H.HALF}) * {H.SPAN} + (r + {H.HALF}) AS cell FROM hot),
li AS MATERIALIZED (SELECT a.slot, a.cell AS a, b.cell AS b FROM id a JOIN id b ON a.slot = b.slot AND a.cell <> b.cell JOIN ep ON ep.slot = a.slot WHERE sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= eps),
reach(slot, a, b) AS (SELECT slot, a, a FROM li UNION SELECT reach.slot, reach.a, li.b FROM reach JOIN li ON li.slot = reach.slot AND li.a = reach.b),
co AS (SELECT slot, a AS cell, min(b) AS component FROM reach GROUP BY 1, 2),
clu AS MATERIALIZED (SELECT id.*, coalesce(component, 0) AS geo_cluster FROM id LEFT JOIN co USING (slot, cell))"""


@query("zone_clusters_per_hour", f"""WITH RECURSIVE {_CLUSTER_SQL} SELECT locality, weekday, hour, cell, geo_cluster FROM clu""")
def zone_clusters(spark, sf):
    """Density clusters of the hot cells of every locality and hour of the week."""
    return G.geo_clusters(hot_zone_cells(zone_cells(spark, sf)), list(Z.SLOT)).select(*Z.SLOT, "cell", "geo_cluster")


_CLEAN_SQL = f"""{_CLUSTER_SQL},
n1 AS (SELECT c.slot, c.cell, count(*) AS n FROM clu c, o JOIN clu d ON d.slot = c.slot AND d.q = c.q + dq AND d.r = c.r + dr AND d.geo_cluster = c.geo_cluster GROUP BY 1, 2 HAVING count(*) > 1),
k1 AS MATERIALIZED (SELECT c.* FROM clu c JOIN n1 USING (slot, cell) QUALIFY count(*) OVER (PARTITION BY c.slot) >= 3),
ho AS (SELECT k.slot, any_value(k.locality) AS locality, any_value(k.weekday) AS weekday, any_value(k.hour) AS hour, k.q + dq AS q, k.r + dr AS r, geo_cluster, count(*) AS n FROM k1 k, o GROUP BY k.slot, k.q + dq, k.r + dr, geo_cluster HAVING count(*) > 3),
hb AS (SELECT * FROM ho WHERE (slot, q, r) NOT IN (SELECT slot, q, r FROM k1) QUALIFY row_number() OVER (PARTITION BY slot, q, r ORDER BY n DESC, geo_cluster) = 1),
k2 AS MATERIALIZED (SELECT slot, locality, weekday, hour, q, r, rides, bill, geo_cluster FROM k1 UNION ALL SELECT hb.slot, locality, weekday, hour, q, r, rides, bill, geo_cluster FROM hb JOIN base USING (locality, weekday, hour, q, r)),
nb AS (SELECT c.slot, c.q, c.r, d.geo_cluster AS other, count(*) AS n FROM k2 c, o JOIN k2 d ON d.slot = c.slot AND d.q = c.q + dq AND d.r = c.r + dr GROUP BY c.slot, c.q, c.r, d.geo_cluster QUALIFY row_number() OVER (PARTITION BY c.slot, c.q, c.r ORDER BY count(*) DESC, d.geo_cluster) = 1),
cl AS MATERIALIZED (SELECT k2.* EXCLUDE (geo_cluster), CASE WHEN n > 3 THEN other ELSE geo_cluster END AS geo_cluster, {8 * (1 << 56)}::BIGINT + (q + {H.HALF}) * {H.SPAN} + (r + {H.HALF}) AS cell FROM k2 LEFT JOIN nb USING (slot, q, r))"""


@query("cleaned_zone_cells", f"""WITH RECURSIVE {_CLEAN_SQL} SELECT locality, weekday, hour, cell, geo_cluster, rides, round(bill, 6) AS bill FROM cl""")
def clean_cells(spark, sf):
    """Lone cells dropped, holes filled from all cells, cells recoloured by their neighbours."""
    return rounded(clean_zone_cells(zone_cells(spark, sf)).select(*Z.SLOT, "cell", "geo_cluster", "rides", "bill"))


@query("zone_prices_and_costs", f"""WITH RECURSIVE {_CLEAN_SQL},
g AS (SELECT locality, weekday, hour, geo_cluster, coalesce(median(bill) FILTER (bill > 0), 0) AS median_bill, sum(rides)::BIGINT AS predict_rides, count(DISTINCT cell) AS cnt_gexagons FROM cl GROUP BY ALL),
p AS (SELECT *, round_even(median_bill * 1.25 / 5, 0) * 5 AS price FROM g)
SELECT locality, weekday, hour, geo_cluster, round(median_bill, 6) AS median_bill, predict_rides, cnt_gexagons, price, round(predict_rides * greatest(price - median_bill, 0), 4) AS cost FROM p""")
def zone_costs(spark, sf):
    """Price, expected rides and cost of every zone."""
    clustered = clean_zone_cells(zone_cells(spark, sf)).withColumn("part", F.lit(0))
    out = Z.cluster_costs(clustered, 1.25)
    return out.select(*Z.SLOT, "geo_cluster", r("median_bill").alias("median_bill"), "predict_rides", "cnt_gexagons", "price", r("predict_total_geominimals", 4).alias("cost"))


_GATE = """count(*) AS rows, count(DISTINCT weekday) AS weekdays, count(DISTINCT hour) AS hours, count(DISTINCT (q, r)) AS cells, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min,
 sum(orders)::BIGINT AS orders, sum(rides)::BIGINT AS rides, round(avg(d2v), 6) AS d2v_mean"""


@query("hex_data_quality_gate", f"""WITH {pts_cells_sql(8)},
base AS (SELECT (user_id % 97 >= 48)::INT AS locality, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour, q, r, any_value(degrees(2*atan(exp(r*{1.5 * _S8!r}/{R0!r})) - pi()/2)) AS lat, any_value(degrees(({math.sqrt(3)!r}::DOUBLE*q + {math.sqrt(3) / 2!r}::DOUBLE*r)*{_S8!r}/{R0!r})) AS lon,
 count(*) FILTER (event_type = 'signup') / count(*)::DOUBLE AS d2v, count(*) FILTER (event_type IN ('click', 'purchase')) AS orders, count(*) FILTER (event_type <> 'error') AS rides FROM cells GROUP BY 1, 2, 3, q, r),
f AS (SELECT max(ts) >= '2024-01-29' AND min(ts) <= '2024-01-02' AND max(ts) FILTER (event_type = 'purchase') >= '2024-01-29' AND min(ts) FILTER (event_type = 'purchase') <= '2024-01-02' AS fresh FROM events),
g AS (SELECT 'all' AS part, {_GATE} FROM base UNION ALL SELECT 'six days', {_GATE} FROM base WHERE weekday < 6 UNION ALL SELECT 'stale', {_GATE} FROM base)
SELECT g.*, CASE WHEN fresh AND part <> 'stale' AND rows > 100 AND weekdays = 7 AND hours = 24 AND cells >= 20 AND lat_min > 37 AND lat_max < 70 AND lon_min > 15 AND lon_min < 179 AND orders > 100 AND rides > 100 AND d2v_mean > 0 AND d2v_mean < 1000 THEN 'ok' ELSE 'error' END AS result FROM g, f""")
def gate(spark, sf):
    """The gate over all hours of the week, over six days of it, and with a source that is not fresh."""
    from curbside.sources.tables import sources_fresh

    ev = table(spark, sf, "events")
    sources = [(ev, "ts"), (ev.filter("event_type = 'purchase'"), "ts")]
    fresh, stale = sources_fresh(sources, "2024-01-02", "2024-01-29"), sources_fresh(sources, "2024-01-02", "2030-01-01")
    cells = G.with_centres(zone_cells(spark, sf))
    cases = (("all", cells, fresh), ("six days", cells.filter("weekday < 6"), fresh), ("stale", cells, stale))
    out = [Z.quality_gate(df, ok).withColumn("part", F.lit(name)) for name, df, ok in cases]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))
