"""Price zones: hot hex cells clustered per slot, priced within a weekly budget."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join, require_columns, require_rows, stable_checkpoint
from ..functions.hexgrid import cell_edge, cell_edges, corner_point
from ..functions.scalars import to_fives
from ..operators import geoclusters as G
from ..operators.polygons import geojson_shapes, smoothed_ring
from ..operators.ranks import cumulative_counts, exact_quantiles

SLOT = ("locality", "weekday", "hour")


@dataclass(frozen=True)
class CityLimits:
    """Weekly limit, d2v quantile bounds and default, views quantile, price multiplier (defaults of the job)."""

    limit: float = 100000
    d2v_min: float = 0.05
    d2v_default: float = 0.15
    d2v_max: float = 0.25
    views_quantile: float = 0.85
    multiplier: float = 1.25


def hex_dataset(demand: DataFrame, rides: DataFrame, bills: DataFrame) -> DataFrame:
    """Demand cells with rides (by slot and cell) and average bills; missing figures are 0."""
    keys = [*SLOT, "cell"]
    out = demand.join(rides, keys, "left").join(bills, keys, "left")
    return out.fillna(0, [c for c in out.columns if c not in demand.columns])


def check_cells(df: DataFrame) -> DataFrame:
    return require_rows(require_columns(df, [*SLOT, "cell", "views", "d2v", "orders", "rides", "bill"]))


def quality_gate(df: DataFrame, sources_ok: DataFrame) -> DataFrame:
    """One row: the measured figures and result = ok / error."""
    m = df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("weekday").alias("weekdays"), F.countDistinct("hour").alias("hours"),
        F.countDistinct("cell").alias("cells"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
        F.min("lon").alias("lon_min"), F.sum("orders").alias("orders"), F.sum("rides").alias("rides"), F.avg("d2v").alias("d2v_mean"),
    )
    flag = sources_ok.select("flag_data_source_no_problems").scalar()
    ok = (
        (flag == 1) & (F.col("rows") > 100) & (F.col("weekdays") == 7) & (F.col("hours") == 24) & (F.col("cells") >= 20)
        & (F.col("lat_min") > 37) & (F.col("lat_max") < 70) & (F.col("lon_min") > 15) & (F.col("lon_min") < 179)
        & (F.col("orders") > 100) & (F.col("rides") > 100) & (F.col("d2v_mean") > 0) & (F.col("d2v_mean") < 1000)
    )
    return m.withColumn("result", F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("error"))


def clustered_slots(hot: DataFrame, everything: DataFrame, slot: Sequence[str] = SLOT) -> DataFrame:
    """Cells with (geo_cluster, part) labels after clustering, clean-up, splitting and hole filling."""
    slot, label = list(slot), ["geo_cluster", "part"]
    df = stable_checkpoint(G.slots_with(hot, slot))
    df = stable_checkpoint(G.geo_clusters(df, slot))
    df = G.drop_isolated(df, slot, ["geo_cluster"], 1)
    df = stable_checkpoint(G.slots_with(df, slot))
    for _ in range(2):
        df = stable_checkpoint(G.fill_holes(df, everything, slot, ["geo_cluster"], 4))
    df = stable_checkpoint(G.split_clusters(G.with_centres(df), slot))
    everything = G.with_centres(everything)
    df = stable_checkpoint(G.recolour_by_neighbours(df, slot, label, 3))
    df = stable_checkpoint(G.slots_with(G.drop_isolated(df, slot, label, 1), slot))
    df = stable_checkpoint(G.fill_holes(df, everything, slot, label, 4))
    df = G.drop_isolated(df, slot, label, 1)
    return stable_checkpoint(G.slots_with(df, slot))


def cluster_costs(clustered: DataFrame, multiplier: float, slot: Sequence[str] = SLOT) -> DataFrame:
    """Price, expected rides and cost per cluster. The median bill is over the cells of one cluster."""
    out = clustered.groupBy(*slot, "geo_cluster", "part").agg(
        F.coalesce(F.median(F.when(F.col("bill") > 0, F.col("bill"))), F.lit(0.0)).alias("median_bill"),
        F.sum("rides").alias("predict_rides"), F.countDistinct("cell").alias("cnt_gexagons"),
    )
    out = out.withColumn("price", to_fives(F.col("median_bill") * multiplier))
    gain = F.greatest(F.col("price") - F.col("median_bill"), F.lit(0.0))
    return out.withColumn("predict_total_geominimals", F.col("predict_rides") * gain)


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Closed walks over the directed outline edges of one cluster, one `part_no` each; clockwise ones bound holes and are left out."""
    step: dict[tuple, list[tuple]] = {}
    for a, b, c, d in pdf[["q0", "r0", "q1", "r1"]].itertuples(index=False):
        step.setdefault((a, b), []).append((c, d))
    rings: list[list[tuple]] = []
    while step:
        at, ring = min(step), []
        while at in step:
            ring.append(at)
            following = step[at].pop()
            if not step[at]:
                del step[at]
            at = following
        twice_area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
        if twice_area > 0:
            rings.append(ring)
    rows = [(i, k, *p) for i, ring in enumerate(rings) for k, p in enumerate(ring)]
    head = pdf.iloc[0]
    keys = [c for c in pdf.columns if c not in ("q0", "r0", "q1", "r1")]
    return pd.DataFrame({**{c: [head[c]] * len(rows) for c in keys}, **{n: [r[j] for r in rows] for j, n in enumerate(("part_no", "seq", "q3", "r3"))}})


def outline_edges(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directed edges of each cluster that no other cell of the cluster shares."""
    edges = clustered.select(*keys, F.explode(cell_edges(F.col("cell"))).alias("e")).select(*keys, "e.*")
    a = F.struct(F.col("q0").alias("q"), F.col("r0").alias("r"))
    b = F.struct(F.col("q1").alias("q"), F.col("r1").alias("r"))
    return (
        edges.groupBy(*keys, F.least(a, b).alias("__lo"), F.greatest(a, b).alias("__hi"))
        .agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct("q0", "r0", "q1", "r1")).alias("e"))
        .filter("__n = 1").select(*keys, "e.*")
    )


def outlines(clustered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rings): the outer outlines of each cluster, one for each separate piece. A group holds only the cluster's
    outline, as its result row does."""
    edges = outline_edges(clustered, keys)
    kinds = dict(edges.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["part_no int, seq int, q3 bigint, r3 bigint"])
    walked = edges.groupBy(*keys).applyInPandas(_walk, schema)
    size = clustered.groupBy(*keys).agg(F.first(cell_edge(F.col("cell"))).alias("__edge"))  # cells of one cluster share a level
    lat, lon = corner_point(F.col("q3"), F.col("r3"), F.col("__edge"))
    point = F.struct("seq", lat.alias("lat"), lon.alias("lon"))
    ring = F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    parts = null_safe_join(walked, size, keys).groupBy(*keys, "part_no").agg(ring.alias("ring"))
    rings = F.transform(F.sort_array(F.collect_list(F.struct("part_no", "ring"))), lambda p: p["ring"])
    return parts.groupBy(*keys).agg(rings.alias("rings"))


def result_dataset(costs: DataFrame, rings: DataFrame, slot: Sequence[str] = SLOT) -> DataFrame:
    """Result columns with the smoothed outlines as GeoJSON; only positive prices."""
    keys = [*slot, "geo_cluster", "part"]
    labels = F.concat_ws("_", F.col("geo_cluster").cast("string"), F.col("part").cast("string"))
    return (
        costs.filter(F.col("price") > 0).join(rings, keys)
        .select(
            *slot, labels.alias("labels"), "price", "predict_rides", "predict_total_geominimals", "cnt_gexagons",
            geojson_shapes(F.transform("rings", lambda ring: smoothed_ring(ring))).alias("polygon"),
        )
    )


def setup_summary(result: DataFrame) -> DataFrame:
    return result.groupBy("locality").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("cnt_gexagons").alias("cells"), F.sum("predict_rides").alias("rides"),
        F.sum("predict_total_geominimals").alias("spend"), F.avg("price").alias("avg_price"),
    )


def spend_by_quantile(cells: DataFrame, limits: CityLimits, candidates: Sequence[float]) -> dict[float, float | None]:
    """Expected spend for every candidate d2v quantile, all in one clustering run (q is one more slot key)."""
    slot = ["q", *SLOT]
    hot = stable_checkpoint(G.hot_cells_for(cells, ["locality", "weekday"], limits.views_quantile, candidates))
    hot = G.cells_with_rides(hot, ["q", "locality"])
    options = F.explode(F.array(*[F.lit(float(q)) for q in candidates]))
    everything = cells.withColumn("q", options)
    costs = cluster_costs(clustered_slots(hot, everything, slot), limits.multiplier, slot)
    rows = costs.groupBy("q").agg(F.sum("predict_total_geominimals").alias("spend")).collect()  # one row per candidate
    found = {row["q"]: float(row["spend"]) for row in rows}
    return {q: found.get(q) for q in candidates}


@dataclass(frozen=True)
class SearchStep:
    q: float
    low: float
    high: float
    cycle: int = 0
    last_step: float = 0.05


def _advance(s: SearchStep, spend: float, limit: float) -> SearchStep:
    """Bisection move: too much spend lowers the quantile towards `low`, otherwise it rises towards `high`."""
    low, high = (s.low, s.q) if spend > limit else (s.q, s.high)
    width = abs(s.q - (low if spend > limit else high)) / 2
    q = s.q - width if spend > limit else s.q + width
    return SearchStep(q, low, high, s.cycle + 1, width)


def _lookahead(s: SearchStep, depth: int) -> list[float]:
    """Quantiles the search can ask for within `depth` evaluations, whatever the spends are."""
    out = [s.q]
    if depth > 1:
        for spend in (1.0, -1.0):
            out += _lookahead(_advance(s, spend, 0.0), depth - 1)
    return out


def find_d2v_quantile(
    spend_of: Callable[[Sequence[float]], dict[float, float | None]], limits: CityLimits, tolerance: float = 0.05,
    rounds: int = 10, smallest_step: float = 0.001, depth: int = 3,
) -> tuple[float, float | None]:
    """Bisection on the d2v quantile until the spend is within tolerance of the limit.

    `spend_of` evaluates several quantiles in one job; each call covers the next `depth`
    bisection steps, so ten rounds take about four jobs. Returns (quantile, spend).
    """
    known: dict[float, float | None] = {}

    def spend_at(s: SearchStep) -> float | None:
        if s.q not in known:
            known.update(spend_of(sorted(set(_lookahead(s, depth)))))
        return known[s.q]

    at = SearchStep(limits.d2v_default, limits.d2v_min, limits.d2v_max)
    spend = spend_at(at) or 0.0
    while abs(spend - limits.limit) > tolerance * limits.limit:
        nxt = _advance(at, spend, limits.limit)
        if at.cycle >= rounds or nxt.last_step < smallest_step:
            at = nxt
            break
        at, value = nxt, spend_at(nxt)
        if value is None:  # nothing left to price at this quantile
            at = SearchStep(limits.d2v_default, at.low, at.high)
            break
        spend = value
    q = at.q if limits.d2v_min <= at.q <= limits.d2v_max else limits.d2v_default
    return round(q, 6), spend


def hot_cells_by_city(cells: DataFrame, candidates: DataFrame, views_quantile: float) -> DataFrame:
    """Hot cells for every candidate (locality, node, q) of a city's d2v quantile, tagged with `node`.

    Running counts of d2v are made once for each (locality, weekday); every candidate reads its quantile from them.
    """
    keys = ["locality", "weekday"]
    runs = cumulative_counts(cells, keys, "d2v", {"n": F.count(F.lit(1))})
    total = runs.groupBy(*keys).agg(F.sum("n").alias("__total"))
    wanted = null_safe_join(null_safe_join(runs, total, keys), candidates, ["locality"])
    at = F.col("q") * (F.col("__total") - 1)
    value = lambda rank: F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("d2v")))
    ends = wanted.groupBy(*keys, "node", at.alias("__at")).agg(value(F.floor(at)).alias("__lo"), value(F.ceil(at)).alias("__hi"))
    limits = ends.select(*keys, "node", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("__at") - F.floor("__at"))).alias("__d2v"))
    views = exact_quantiles(cells, keys, "views", {"__views": views_quantile})
    busy = null_safe_join(cells, views, keys).filter(F.col("views") >= F.col("__views")).drop("__views")
    return null_safe_join(busy, stable_checkpoint(limits), keys).filter(F.col("d2v") <= F.col("__d2v")).drop("__d2v")


def zone_costs_by_city(cells: DataFrame, candidates: DataFrame, limits: CityLimits) -> DataFrame:
    """Zones with their costs for every candidate (locality, node, q), all in one clustering run."""
    slot = ["node", *SLOT]
    hot = G.cells_with_rides(stable_checkpoint(hot_cells_by_city(cells, candidates, limits.views_quantile)), ["node", "locality"])
    everything = null_safe_join(cells, candidates.drop("q"), ["locality"])
    return cluster_costs(clustered_slots(hot, everything, slot), limits.multiplier, slot)


def spend_by_city(cells: DataFrame, candidates: DataFrame, limits: CityLimits) -> DataFrame:
    """(locality, node, spend) for every candidate (locality, node, q)."""
    return zone_costs_by_city(cells, candidates, limits).groupBy("locality", "node").agg(F.sum("predict_total_geominimals").alias("spend"))


def _moved(q: Column, low: Column, high: Column, too_much: Column) -> tuple[Column, Column, Column, Column]:
    """(q, low, high, width) after a bisection move, as `_advance` makes it."""
    new_low, new_high = F.when(too_much, low).otherwise(q), F.when(too_much, q).otherwise(high)
    width = F.abs(q - F.when(too_much, low).otherwise(high)) / 2
    return F.when(too_much, q - width).otherwise(q + width), new_low, new_high, width


def search_cities(
    spend_of: Callable[[DataFrame], DataFrame], budgets: DataFrame, limits: CityLimits, tolerance: float = 0.05, rounds: int = 10, smallest_step: float = 0.001, depth: int = 3,
) -> DataFrame:
    """(locality, limit, q, spend): the search of `find_d2v_quantile` for all cities of (locality, limit) at once.

    The state is a table with one row a city. `spend_of` gets (locality, node, q), the quantiles each open city can ask for
    within `depth` moves, numbered as a binary tree, and gives (locality, node, spend). All open cities then move by column
    expressions; the table is written once a job.
    """
    start = {"q": F.lit(float(limits.d2v_default)), "low": F.lit(float(limits.d2v_min)), "high": F.lit(float(limits.d2v_max)), "cycle": F.lit(0), "spend": F.lit(0.0), "done": F.lit(False)}
    state = stable_checkpoint(budgets.select("locality", F.col("limit").cast("double").alias("limit")).withColumns(start))
    while not state.filter("NOT done").isEmpty():
        nodes = [(1, F.col("q"), F.col("low"), F.col("high"))]
        for k, q, low, high in nodes:
            if k < 1 << (depth - 1):
                nodes += [(2 * k + i, *_moved(q, low, high, F.lit(i == 0))[:3]) for i in (0, 1)]
        tree = F.explode(F.array(*[F.struct(F.lit(k).alias("node"), q.alias("q")) for k, q, _, _ in nodes])).alias("c")
        candidates = stable_checkpoint(state.filter("NOT done").select("locality", tree).select("locality", "c.*"))
        found = spend_of(candidates).groupBy("locality").agg(F.map_from_entries(F.collect_list(F.struct("node", "spend"))).alias("found"))  # 2^depth - 1 at most
        state = null_safe_join(state, found, ["locality"], "left").withColumns({"node": F.lit(1), "found": F.coalesce("found", F.create_map().cast("map<int,double>"))})
        for _ in range(depth):
            value = F.try_element_at("found", F.col("node"))
            state = state.withColumns({"live": ~F.col("done") & (F.col("node") < 1 << depth), "value": value})
            empty = F.col("live") & F.col("value").isNull() & (F.col("cycle") > 0)  # nothing left to price at this quantile
            state = state.withColumns({
                "q": F.when(empty, F.lit(float(limits.d2v_default))).otherwise(F.col("q")), "spend": F.when(F.col("live") & ~empty, F.coalesce("value", F.lit(0.0))).otherwise(F.col("spend")),
                "done": F.col("done") | empty, "live": F.col("live") & ~empty,
            })
            state = state.withColumn("done", F.col("done") | (F.col("live") & (F.abs(F.col("spend") - F.col("limit")) <= tolerance * F.col("limit")))).withColumn("live", F.col("live") & ~F.col("done"))
            too_much = F.col("spend") > F.col("limit")
            q, low, high, width = _moved(F.col("q"), F.col("low"), F.col("high"), too_much)
            last = F.col("live") & ((F.col("cycle") >= rounds) | (width < smallest_step))
            move = lambda new, old: F.when(F.col("live"), new).otherwise(F.col(old))
            state = state.withColumns({
                "q": move(q, "q"), "low": move(low, "low"), "high": move(high, "high"), "cycle": move(F.col("cycle") + 1, "cycle"), "done": F.col("done") | last,
                "node": move(2 * F.col("node") + F.when(too_much, 0).otherwise(1), "node"),
            })
        state = stable_checkpoint(state.select("locality", "limit", *start))
    inside = F.col("q").between(limits.d2v_min, limits.d2v_max)
    return state.select("locality", "limit", F.round(F.when(inside, F.col("q")).otherwise(F.lit(float(limits.d2v_default))), 6).alias("q"), "spend")


def suggest_prices(cells: DataFrame, limits: CityLimits, q_d2v: float) -> DataFrame:
    """Final suggestion rows at one d2v quantile."""
    hot = stable_checkpoint(G.hot_cells(cells, ["locality", "weekday"], limits.views_quantile, q_d2v))
    hot = G.cells_with_rides(hot, ["locality"])
    clustered = clustered_slots(hot, cells)
    keys = [*SLOT, "geo_cluster", "part"]
    return result_dataset(cluster_costs(clustered, limits.multiplier), outlines(clustered, keys))
