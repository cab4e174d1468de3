"""Hex cells, polygons and clusters against hand cases and brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from curbside.functions import hexgrid as H
from curbside.operators import geoclusters as G
from curbside.operators import polygons as P
from curbside.plans import geo_pricing as Z


def ring(*pts):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in pts])


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_cell_round_trip_and_neighbours(spark):
    rng = random.Random(1)
    pts = spark.createDataFrame([(rng.uniform(45, 60), rng.uniform(30, 60)) for _ in range(500)], "lat double, lon double")
    df = pts.select(H.point_cell(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    lat, lon = H.cell_centre(F.col("cell"))
    assert df.filter(H.point_cell(lat, lon, 8) != F.col("cell")).count() == 0
    near = df.select("cell", F.explode(H.cell_neighbours(F.col("cell"))).alias("n"))
    x, y = H.plane_centre(F.col("cell"))
    nx, ny = H.plane_centre(F.col("n"))
    d = near.select(F.hypot(x - nx, y - ny).alias("d")).agg(F.min("d"), F.max("d"), F.count("*")).first()
    want = H.edge_length(8) * math.sqrt(3)
    assert d[0] == pytest.approx(want) and d[1] == pytest.approx(want) and d[2] == 6 * df.count()
    assert len(H.ring_offsets(2)) == 12


def test_corners_are_shared(spark):
    cell = H.point_cell(F.lit(55.5), F.lit(37.3), 8)
    a = one(spark, H.cell_corners(cell).alias("a"), F.transform(H.cell_neighbours(cell), lambda n: H.cell_corners(n)).alias("b"))
    mine = {(round(p.lat, 8), round(p.lon, 8)) for p in a.a}
    for other in a.b:
        assert len(mine & {(round(p.lat, 8), round(p.lon, 8)) for p in other}) == 2


def test_outline_of_a_flower(spark):
    c = H.point_cell(F.lit(55.5), F.lit(37.3), 8)
    cells = spark.range(1).select(F.explode(F.concat(F.array(c), H.cell_neighbours(c))).alias("cell")).withColumn("g", F.lit(1))
    edges = Z.outline_edges(cells, ["g"])
    assert edges.count() == 18
    [shape] = Z.outlines(cells, ["g"]).first().rings
    assert len(shape) == 18
    area = Z.outlines(cells, ["g"]).select(P.ring_area(F.col("rings")[0])).first()[0]
    single = cells.limit(1).select(P.ring_area(H.cell_corners(F.col("cell")))).first()[0]
    assert area == pytest.approx(7 * single, rel=1e-3)


def test_point_in_ring_cases(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    concave = ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    inside = lambda a, b, r: one(spark, P.point_in_ring(F.lit(float(a)), F.lit(float(b)), r).alias("x")).x
    assert inside(1, 1, square) and not inside(3, 1, square) and not inside(1, -1, square)
    assert inside(0.5, 1, concave) and not inside(2, 3, concave) and inside(3.9, 3, concave)


def test_ring_distance_area_and_buffer(spark):
    square = ring((55.0, 37.0), (55.01, 37.0), (55.01, 37.01), (55.0, 37.01))
    row = one(
        spark, P.ring_area(square).alias("area"), P.in_surrounding_area(F.lit(55.005), F.lit(37.012), square, 1000.0).alias("near"),
        P.in_surrounding_area(F.lit(55.005), F.lit(37.005), square, 1000.0).alias("inner"), P.in_surrounding_area(F.lit(55.005), F.lit(37.2), square, 1000.0).alias("far"),
    )
    want = (math.radians(0.01) * H.EARTH_RADIUS) ** 2 * math.cos(math.radians(55.005))
    assert row.area == pytest.approx(want, rel=1e-4) and row.near and not row.inner and not row.far


def test_smoothing_keeps_ends_and_geojson_swaps(spark):
    r0 = ring((0, 0), (4, 0), (4, 4))
    row = one(spark, P.smoothed_ring(r0, 1).alias("s"), P.geojson(r0).alias("g"))
    assert [(p.lat, p.lon) for p in row.s] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 3), (4, 4)]
    assert json.loads(row.g)["coordinates"][0][1] == [0.0, 4.0] and json.loads(row.g)["coordinates"][0][-1] == [0.0, 0.0]


def test_schedule_json_parsing(spark):
    rows = [(1, 2, '[{"id":1,"name":"z","price":5,"coords":[["55.1","37.2"],["55.2","37.2"],["55.2","37.3"]]}]'), (2, 3, "[]"), (3, None, "[]")]
    got = P.parse_schedule(spark.createDataFrame(rows, "campaign_id int, week_day int, polygons string")).collect()
    assert len(got) == 1 and got[0].polygon == "z" and (got[0].ring[0].lat, got[0].ring[0].lon) == (55.1, 37.2)


def test_polygon_join_against_brute_force(spark):
    rng = random.Random(6)
    pts = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(400)]
    shapes = [(k, [(0.1 * k, 0.1), (0.1 * k + 0.5, 0.2), (0.1 * k + 0.2, 0.7)]) for k in range(4)]
    polys = spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in s]) for k, s in shapes], "k int, ring array<struct<lat:double,lon:double>>")
    got = {(r.i, r.k) for r in P.polygon_join(spark.createDataFrame(pts, "i int, lat double, lon double"), polys, tile=0.13).collect()}

    def side(p, a, b):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    want = set()
    for i, la, lo in pts:
        for k, s in shapes:
            signs = {side((la, lo), s[j], s[(j + 1) % 3]) > 0 for j in range(3)}
            if len(signs) == 1:
                want.add((i, k))
    assert got == want and want


def axial(spark, coords, slot=1):
    rows = [(slot, q, r) for q, r in coords]
    return spark.createDataFrame(rows, "slot int, q int, r int").select("slot", H.cell_id(F.col("q") + 4700, F.col("r") + 10000, 8).alias("cell"), "q", "r")


def test_components_against_union_find(spark):
    rng = random.Random(2)
    coords = list({(rng.randrange(14), rng.randrange(14)) for _ in range(90)})
    both = axial(spark, coords).unionByName(axial(spark, coords[:30], 2))
    comp = G.connected_components(both, G.neighbour_links(both, ["slot"]), ["slot"])
    got = both.join(comp, ["slot", "cell"]).collect()
    for slot, cells in ((1, set(coords)), (2, set(coords[:30]))):
        parent = {c: c for c in cells}

        def find(c):
            while parent[c] != c:
                c = parent[c]
            return c

        for q, r in cells:
            for dq, dr in H.OFFSETS:
                if (q + dq, r + dr) in cells:
                    parent[find((q + dq, r + dr))] = find((q, r))
        groups = {}
        for row in got:
            if row.slot == slot:
                groups.setdefault(row.component, set()).add(find((row.q, row.r)))
        assert all(len(v) == 1 for v in groups.values()) and len(groups) == len({find(c) for c in cells})


def test_clean_up_rules(spark):
    flower = [(0, 0), *H.OFFSETS]
    cells = axial(spark, [*flower, (5, 5)]).withColumn("geo_cluster", F.lit(1).cast("bigint"))
    kept = {(r.q, r.r) for r in G.drop_isolated(cells, ["slot"], ["geo_cluster"], 1).collect()}
    assert kept == set(flower)
    ring_only = cells.filter("not (q = 0 and r = 0) and q < 5")
    everything = axial(spark, [*flower, (9, 9)]).withColumn("geo_cluster", F.lit(0).cast("bigint"))
    filled = G.fill_holes(ring_only, everything.drop("geo_cluster"), ["slot"], ["geo_cluster"], 4).collect()
    assert {(r.q, r.r) for r in filled} == set(flower) and {r.geo_cluster for r in filled} == {1}
    odd = cells.withColumn("geo_cluster", F.when((F.col("q") == 0) & (F.col("r") == 0), 9).otherwise(1).cast("bigint")).filter("q < 5")
    assert {r.geo_cluster for r in G.recolour_by_neighbours(odd, ["slot"], ["geo_cluster"], 3).collect()} == {1}


def test_single_cells_are_noise_and_pairs_cluster(spark):
    df = axial(spark, [(0, 0), (1, 0), (8, 8)])
    got = {(r.q, r.r): r.geo_cluster for r in G.geo_clusters(df, ["slot"]).collect()}
    assert got[(8, 8)] == 0 and got[(0, 0)] == got[(1, 0)] != 0


def test_big_clusters_split_by_bill(spark):
    coords = [(q, r) for q in range(6) for r in range(5)]
    df = axial(spark, coords).withColumn("geo_cluster", F.lit(1).cast("bigint")).withColumn("bill", F.when(F.col("q") < 3, 100.0).otherwise(900.0))
    df = G.with_centres(df)
    parts = {(r.q, r.r): r.part for r in G.split_clusters(df, ["slot"]).collect()}
    low, high = {parts[c] for c in coords if c[0] < 3}, {parts[c] for c in coords if c[0] >= 3}
    assert not low & high and 0 not in low | high
    small = G.with_centres(axial(spark, coords[:8]).withColumn("geo_cluster", F.lit(1).cast("bigint")).withColumn("bill", F.lit(1.0)))
    assert {r.part for r in G.split_clusters(small, ["slot"]).collect()} == {0}


def test_cluster_costs(spark):
    df = spark.createDataFrame([(1, 0, 8, 7, 0, 1, 100.0, 3), (1, 0, 8, 7, 0, 2, 0.0, 2), (1, 0, 8, 7, 0, 3, 110.0, 1)],
                               "locality int, weekday int, hour int, geo_cluster bigint, part int, cell bigint, bill double, rides int")
    r = Z.cluster_costs(df, 1.25).first()
    assert (r.median_bill, r.price, r.predict_rides, r.cnt_gexagons) == (105.0, 130.0, 6, 3) and r.predict_total_geominimals == 150.0


def test_overlap_share(spark):
    a = axial(spark, [(0, 0), (1, 0), (2, 0), (3, 0)])
    b = axial(spark, [(1, 0), (2, 0), (9, 9)])
    r = P.overlap_share(a, b, ["slot"]).first()
    assert (r.active_cells, r.suggested_cells, r.shared_cells, r.share) == (4, 3, 2, 0.5)


@pytest.mark.parametrize("level", [7, 8])
def test_zone_outlines_lie_where_the_cells_are(spark, level):
    c = H.point_cell(F.lit(55.5), F.lit(37.3), level)
    far = H.point_cell(F.lit(55.9), F.lit(37.3), level)
    both = F.concat(F.array(c), H.cell_neighbours(c), F.array(far))
    cells = spark.range(1).select(F.explode(both).alias("cell")).withColumn("g", F.lit(1))
    rings = Z.outlines(cells, ["g"]).first().rings
    assert sorted(len(r) for r in rings) == [6, 18]  # both pieces
    assert all(55.3 < p.lat < 56.1 and 37.1 < p.lon < 37.5 for r in rings for p in r)
    assert one(spark, H.cell_level(c).alias("a")).a == level


def test_hole_is_not_an_outline(spark):
    c = H.point_cell(F.lit(55.5), F.lit(37.3), 8)
    cells = spark.range(1).select(F.explode(H.cell_neighbours(c)).alias("cell")).withColumn("g", F.lit(1))
    [ring_] = Z.outlines(cells, ["g"]).first().rings
    assert len(ring_) == 18


def test_ring_reach_grows_with_latitude(spark):
    for lat, want in ((0.5, 2), (55.5, 3), (80.0, 7)):
        cells = G.with_centres(spark.range(1).select(H.point_cell(F.lit(lat), F.lit(37.3), 8).alias("cell"), F.lit(1).alias("s")))
        assert G.ring_reach(cells, G.cluster_radius(cells, ["s"])) == want


def _inside(lat, lon, ring):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (a > lat) != (c > lat) and lon < b + (lat - a) * (d - b) / (c - a):
            hit = not hit
    return hit


@pytest.mark.parametrize("tile", [0.7, 0.11, 0.03])
def test_tile_cover_equals_ray_casting(spark, tile):
    """Points on a lattice (tile corners and fine-tile corners among them), thin, concave and crossing rings, null points."""
    rng = random.Random(int(tile * 100))
    rings = [[(rng.uniform(0, 1), rng.uniform(-1, 1)) for _ in range(rng.randint(3, 9))] for _ in range(6)] + [[(0.0, -0.5), (tile * 2, -0.5), (tile * 2, 0.5), (0.0, 0.5)], [(0.2, 0.0), (0.8, 0.0001), (0.2, 0.0002)]]
    points = [(i, rng.choice([rng.uniform(0, 1), rng.randrange(9) * tile / 8]), rng.choice([rng.uniform(-1, 1), rng.randrange(-9, 9) * tile / 8])) for i in range(600)] + [(600, None, 0.1), (601, 0.1, None)]
    pts = spark.createDataFrame(points, "i int, lat double, lon double").repartition(3)
    polys = spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in ring]) for k, ring in enumerate(rings)], "k int, ring array<struct<lat:double,lon:double>>")
    want = {(i, k) for i, lat, lon in points if lat is not None and lon is not None for k, ring in enumerate(rings) if _inside(lat, lon, ring)}
    got = [(r.i, r.k) for r in P.polygon_join(pts, polys, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    flags = {r.i: r.is_in for r in P.in_any_polygon(pts, polys, tile=tile).collect()}
    assert flags == {i: any((i, k) in want for k in range(len(rings))) for i, _, _ in points}
    keyed = P.in_any_polygon(pts.withColumn("k", F.col("i") % 8), polys, tile=tile, keys=["k"]).collect()
    assert {r.i for r in keyed if r.is_in} == {i for i, k in want if i % 8 == k}
    cover = P.tile_cover(polys, tile=tile)
    assert tile > 0.5 or cover.filter("__whole").count() or tile > 0.1
    assert P.in_any_polygon(pts, polys.limit(0), tile=tile).filter("is_in").isEmpty()


def test_scheduled_areas_against_loops(spark):
    """Times to the minute, midnight, rows without weekday or length, two localities, buffer distance."""
    import datetime as dt

    rng = random.Random(3)
    ring = [(55.50, 37.30), (55.56, 37.33), (55.50, 37.38)]
    plan = [(1, 1, 1, 8, 10, 9, 40), (2, 1, 1, 9, 0, 24, 0), (3, 2, 7, 0, 0, 0, 1), (4, 2, None, 0, 0, 24, 0), (5, 1, 3, 10, 0, 10, 0), (6, 2, 3, 23, 59, 24, 0)]
    shape = [{"lat": a, "lon": b} for a, b in ring]
    schedule = spark.createDataFrame([(*p, shape) for p in plan], "row int, loc int, week_day int, from_hour int, from_minute int, until_hour int, until_minute int, ring array<struct<lat:double,lon:double>>")
    points = []
    for i in range(900):
        day = rng.choice([1, 3, 7, 2])
        points.append((i, rng.choice([1, 2]), dt.datetime(2024, 1, day, rng.choice([0, 8, 9, 10, 23]), rng.choice([0, 1, 9, 10, 39, 40, 59])), rng.uniform(55.49, 55.57), rng.uniform(37.29, 37.39)))
    frame = spark.createDataFrame(points, "i int, loc int, ts timestamp, lat double, lon double")

    def near(lat, lon):
        to = lambda a, b: (math.radians(b) * 6371007.180918475, math.log(math.tan(math.pi / 4 + math.radians(a) / 2)) * 6371007.180918475)
        scale = H.EARTH_RADIUS / 6371007.180918475
        px, py = (v * scale for v in to(lat, lon))
        best = math.inf
        for p, q in zip(ring, ring[1:] + ring[:1]):
            (ax, ay), (bx, by) = ((v[0] * scale, v[1] * scale) for v in (to(*p), to(*q)))
            t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            best = min(best, math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay)))
        return best

    want = set()
    for i, loc, ts, lat, lon in points:
        for row, where, day, fh, fm, uh, um in plan:
            minute = ts.hour * 60 + ts.minute
            if where == loc and day == ts.isoweekday() and fh * 60 + fm <= minute < uh * 60 + um:
                if _inside(lat, lon, ring):
                    want.add((i, row, True))
                elif near(lat, lon) <= 900:
                    want.add((i, row, False))
    got = P.scheduled_polygon_join(frame, schedule, keys=["loc"], metres=900.0, tile=0.01).collect()
    assert {(r.i, r.row, r.in_polygon) for r in got} == want and len(got) == len(want) and all(r.in_buffer != r.in_polygon for r in got)
    inside = P.scheduled_polygon_join(frame, schedule, keys=["loc"], tile=0.3).collect()
    assert {(r.i, r.row) for r in inside} == {(i, row) for i, row, core in want if core}
