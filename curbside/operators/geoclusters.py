"""Clusters of hexagonal cells, for all slots at once.

Every step is a join or aggregate on (slot keys, cell), so slots and cells spread
over tasks freely. Iterations cut lineage with reliable checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join, stable_checkpoint
from ..functions.hexgrid import EARTH_RADIUS, cell_centre, cell_edge, cell_neighbours
from .ranks import exact_quantiles

KMEANS_ROUNDS = 300  # a fit that has not settled by then is an error


def with_centres(df: DataFrame, cell: str = "cell") -> DataFrame:
    lat, lon = cell_centre(F.col(cell))
    return df.withColumns({"lat": lat, "lon": lon})


def hot_cells(df: DataFrame, keys: Sequence[str], q_views: float, q_d2v: float) -> DataFrame:
    """Cells with views at or above and d2v at or below their quantiles per key."""
    views = exact_quantiles(df, keys, "views", {"__views": q_views})
    out = null_safe_join(df, views, keys).filter(F.col("views") >= F.col("__views")).drop("__views")
    d2v = exact_quantiles(df, keys, "d2v", {"__d2v": q_d2v})
    return null_safe_join(out, d2v, keys).filter(F.col("d2v") <= F.col("__d2v")).drop("__d2v")


def hot_cells_for(df: DataFrame, keys: Sequence[str], q_views: float, candidates: Sequence[float]) -> DataFrame:
    """Hot cells for every candidate d2v quantile, tagged in column `q`."""
    names = {f"__q{i}": q for i, q in enumerate(candidates)}
    views = exact_quantiles(df, keys, "views", {"__views": q_views})
    d2v = exact_quantiles(df, keys, "d2v", names)
    base = null_safe_join(df, views, keys).filter(F.col("views") >= F.col("__views")).drop("__views")
    base = null_safe_join(base, d2v, keys)
    options = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(n).alias("limit")) for n, q in names.items()])
    wide = base.withColumn("__o", F.explode(F.filter(options, lambda o: F.col("d2v") <= o["limit"])))
    return wide.withColumn("q", F.col("__o.q")).drop("__o", *names)


def cells_with_rides(df: DataFrame, keys: Sequence[str], rides: str = "rides", at_least: int = 2) -> DataFrame:
    """Rows of cells that had enough rides in at least one row of the key."""
    used = df.filter(F.col(rides) >= at_least).select(*keys, "cell").distinct()
    return df.join(used, [*keys, "cell"], "left_semi")


def neighbour_links(df: DataFrame, slot: Sequence[str], max_ring: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """(slot, cell, other, carry of other): pairs of neighbouring cells that are both present."""
    pairs = df.select(*slot, "cell", *[f"{c}" for c in carry]).withColumn(
        "other", F.explode(cell_neighbours(F.col("cell"), max_ring))
    )
    # from the view of `other`: `cell` is its neighbour and carries its columns along
    near = pairs.select(*slot, F.col("other").alias("cell"), F.col("cell").alias("other"), *[F.col(c).alias(f"other_{c}") for c in carry])
    return df.select(*slot, "cell").join(near, [*slot, "cell"])


def cluster_radius(df: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Per slot: 0.2 * mean + 0.8 * max of the widest centre distance to a ring-1 neighbour, in degrees."""
    lat, lon = cell_centre(F.col("cell"))

    def distance(n):
        la, lo = cell_centre(n)
        return F.sqrt((la - lat) * (la - lat) + (lo - lon) * (lo - lon))

    widest = F.array_max(F.transform(cell_neighbours(F.col("cell")), distance))
    per_cell = df.select(*slot, "cell").distinct().withColumn("__w", widest)
    return per_cell.groupBy(*slot).agg((0.2 * F.avg("__w") + 0.8 * F.max("__w")).alias("eps"))


def connected_components(nodes: DataFrame, links: DataFrame, keys: Sequence[str], max_rounds: int = 60) -> DataFrame:
    """(keys, cell, component): smallest cell id reachable over the links, by label exchange with pointer jumping."""
    keys = list(keys)
    labels = stable_checkpoint(nodes.select(*keys, "cell").distinct().withColumn("component", F.col("cell")))
    links = stable_checkpoint(links.select(*keys, "cell", "other"))

    def spread_labels(current):
        other = current.select(*keys, F.col("cell").alias("other"), F.col("component").alias("__c"))
        best = links.join(other, [*keys, "other"]).groupBy(*keys, "cell").agg(F.min("__c").alias("__b"))
        step = current.join(best, [*keys, "cell"], "left").withColumn(
            "__new", F.least(F.col("component"), F.coalesce("__b", F.col("component")))
        )
        # pointer jump: follow the label of the label
        target = step.select(*keys, F.col("cell").alias("__new"), F.col("__new").alias("__jump"))
        return step.join(target, [*keys, "__new"], "left").select(
            *keys, "cell", F.col("component").alias("__old"), F.least("__new", F.coalesce("__jump", "__new")).alias("component")
        )

    for _ in range(max_rounds):
        # two exchanges per written table; a round of pointer jumps halves the distance to the smallest label
        labels = stable_checkpoint(spread_labels(spread_labels(labels).drop("__old")))
        if labels.filter(F.col("__old") != F.col("component")).isEmpty():
            return labels.drop("__old")
        labels = labels.drop("__old")
    raise RuntimeError("components did not settle; raise max_rounds")


def ring_reach(cells: DataFrame, eps: DataFrame) -> int:
    """Hex steps within which every cell at most eps degrees away lies.

    A step covers least going straight north or south, where it is 1.5 edges on the plane, shrunk by the cosine of the latitude.
    """
    step = F.degrees(cell_edge(F.col("cell")) * 1.5 / EARTH_RADIUS) * F.cos(F.radians("lat"))
    least, widest = cells.agg(F.min(step)).first()[0], eps.agg(F.max("eps")).first()[0]
    return max(1, math.ceil(widest / least)) if least else 1


def geo_clusters(df: DataFrame, slot: Sequence[str], min_samples: int = 2) -> DataFrame:
    """Density clusters of cells within the slot's radius; adds `geo_cluster` (0 = noise).

    A cell is a core when it and its neighbours within the radius number min_samples or more.
    Clusters are the components of the core graph; other cells join a neighbouring core's cluster.
    """
    slot = list(slot)
    cells = stable_checkpoint(with_centres(df.select(*slot, "cell").distinct()))
    eps = stable_checkpoint(cluster_radius(cells, slot))
    links = neighbour_links(cells, slot, ring_reach(cells, eps), carry=["lat", "lon"])
    links = null_safe_join(links.join(cells, [*slot, "cell"]), eps, slot)
    gap = F.sqrt(F.pow(F.col("lat") - F.col("other_lat"), 2) + F.pow(F.col("lon") - F.col("other_lon"), 2))
    # equal distances count as within the radius, whatever their last digits
    links = stable_checkpoint(links.filter(gap <= F.col("eps") * (1 + 1e-9)).select(*slot, "cell", "other"))
    cores = links.groupBy(*slot, "cell").agg(F.count(F.lit(1)).alias("__d")).filter(F.col("__d") + 1 >= min_samples)
    cores = cores.select(*slot, "cell")
    core_links = links.join(cores, [*slot, "cell"], "left_semi").join(
        cores.withColumnRenamed("cell", "other"), [*slot, "other"], "left_semi"
    )
    comp = connected_components(cores, core_links, slot)
    border = (
        links.join(comp.select(*slot, F.col("cell").alias("other"), F.col("component").alias("__c")), [*slot, "other"])
        .groupBy(*slot, "cell").agg(F.min("__c").alias("__near"))
    )
    return (
        df.join(comp, [*slot, "cell"], "left").join(border, [*slot, "cell"], "left")
        .withColumn("geo_cluster", F.coalesce("component", "__near", F.lit(0)))
        .drop("component", "__near")
    )


def _same_cluster_neighbours(df: DataFrame, slot: Sequence[str], label: Sequence[str]) -> DataFrame:
    links = neighbour_links(df, slot, 1, carry=label)
    own = df.select(*slot, "cell", *label)
    joined = links.join(own, [*slot, "cell"])
    same = F.lit(True)
    for c in label:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return joined.groupBy(*slot, "cell").agg(F.count_if(same).alias("__near"))


def drop_isolated(df: DataFrame, slot: Sequence[str], label: Sequence[str], more_than: int = 1) -> DataFrame:
    """Keeps cells with more than `more_than` ring-1 neighbours of their own cluster."""
    near = _same_cluster_neighbours(df, slot, label).filter(F.col("__near") > more_than).select(*slot, "cell")
    return df.join(near, [*slot, "cell"], "left_semi")


def recolour_by_neighbours(df: DataFrame, slot: Sequence[str], label: Sequence[str], more_than: int = 3) -> DataFrame:
    """A cell takes the label of its most common neighbour cluster when that has more than `more_than` cells.

    All cells see the labels of the round before.
    """
    links = neighbour_links(df, slot, 1, carry=label)
    other = [f"other_{c}" for c in label]
    counts = links.groupBy(*slot, "cell", *other).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(*slot, "cell").agg(
        F.max_by(F.struct("__n", *other), F.struct(F.col("__n"), *[-F.col(c) for c in other])).alias("__b")
    )
    joined = df.join(best, [*slot, "cell"], "left")
    take = F.coalesce(F.col("__b.__n") > more_than, F.lit(False))
    return joined.withColumns(
        {c: F.when(take, F.col(f"__b.other_{c}")).otherwise(F.col(c)) for c in label}
    ).drop("__b")


def fill_holes(df: DataFrame, everything: DataFrame, slot: Sequence[str], label: Sequence[str], more_than: int = 4) -> DataFrame:
    """Adds absent cells that have more than `more_than` neighbours in one cluster, with their row from `everything`."""
    around = df.select(*slot, *label, F.explode(cell_neighbours(F.col("cell"))).alias("cell"))
    counts = around.groupBy(*slot, "cell", *label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > more_than)
    best = counts.groupBy(*slot, "cell").agg(
        F.max_by(F.struct(*label), F.struct(F.col("__n"), *[-F.col(c) for c in label])).alias("__b")
    )
    holes = best.join(df.select(*slot, "cell"), [*slot, "cell"], "left_anti").select(*slot, "cell", "__b.*")
    rows = everything.join(holes, [*slot, "cell"])
    return df.unionByName(rows.select(*df.columns))


def slots_with(df: DataFrame, slot: Sequence[str], at_least: int = 3) -> DataFrame:
    """Rows of slots that still hold enough cells."""
    keep = df.groupBy(*slot).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= at_least).select(*slot)
    return df.join(keep, list(slot), "left_semi")


def split_clusters(
    df: DataFrame, slot: Sequence[str], features: Sequence[str] = ("lat", "lon", "bill"), big: int = 9, per_part: int = 7,
    max_k: int = 8,
) -> DataFrame:
    """Splits clusters of at least `big` cells by k-means on standardised features; adds `part` (0 when not split).

    All clusters and all k are fitted together: centres are an array of at most max_k points per
    (cluster, k). k is the best squared-distance silhouette over 2..max_k, then at most cells // per_part.
    """
    grp = [*slot, "geo_cluster"]
    stats = df.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("__cells"),
        *[F.avg(f).alias(f"__m_{f}") for f in features], *[F.stddev_pop(f).alias(f"__s_{f}") for f in features],
    ).filter(F.col("__cells") >= big)
    scaled = df.select(*grp, "cell", *features).join(stats, grp).select(
        *grp, "cell", "__cells",
        F.array(*[
            F.coalesce(F.try_divide(F.col(f) - F.col(f"__m_{f}"), F.col(f"__s_{f}")), F.lit(0.0)) for f in features
        ]).alias("z"),
    ).withColumn("__s", F.aggregate("z", F.lit(0.0), lambda a, v: a + v))
    points = scaled.withColumn(
        "k", F.explode(F.sequence(F.lit(2), F.least(F.lit(max_k), (F.col("__cells") - 1).cast("int"))))
    )
    points = stable_checkpoint(points)
    fit = [*grp, "k"]
    span = points.groupBy(*fit).agg(F.min("__s").alias("__lo"), F.max("__s").alias("__hi"))
    start = F.least(
        F.col("k") - 1,
        F.coalesce(F.floor(F.try_divide(F.col("__s") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * F.col("k")), F.lit(0)),
    ).cast("int")
    assigned = points.join(span, fit).withColumn("c", start).select(*fit, "cell", "z", "c")
    dims = range(len(features))

    def centres(frame):
        means = frame.groupBy(*fit, "c").agg(*[F.avg(F.col("z")[i]).alias(f"__z{i}") for i in dims])
        point = F.struct("c", F.array(*[f"__z{i}" for i in dims]).alias("m"))
        return means.groupBy(*fit).agg(F.sort_array(F.collect_list(point)).alias("__centres"))  # at most max_k

    def squared(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)

    for i in range(1, KMEANS_ROUNDS + 1):  # until no point changes its part; looked at every fifth round
        nearest = F.array_min(F.transform("__centres", lambda p: F.struct(squared(F.col("z"), p["m"]).alias("d"), p["c"].alias("c"))))
        moved = assigned.select(*fit, "cell", "z", F.col("c").alias("__old")).join(centres(assigned), fit)
        assigned = moved.withColumn("c", nearest["c"]).drop("__centres")
        if i % 5 == 0:
            assigned = stable_checkpoint(assigned)
            if assigned.filter(F.col("c") != F.col("__old")).isEmpty():
                break
    else:
        raise RuntimeError(f"parts did not settle in {KMEANS_ROUNDS} rounds")
    assigned = assigned.drop("__old")

    # mean squared distance from a point to a part follows from the part's size, mean and mean square
    norm = F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v)
    parts = assigned.groupBy(*fit, "c").agg(
        F.count(F.lit(1)).alias("n"), F.avg(norm).alias("sq"), *[F.avg(F.col("z")[i]).alias(f"__z{i}") for i in dims]
    )
    listed = parts.groupBy(*fit).agg(
        F.collect_list(F.struct("c", "n", "sq", F.array(*[f"__z{i}" for i in dims]).alias("m"))).alias("__parts")
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    mean_sq = lambda p: norm + p["sq"] - 2 * dot(F.col("z"), p["m"])
    scored = assigned.join(listed, fit).withColumns(
        {
            "__own": F.element_at(F.filter("__parts", lambda p: p["c"] == F.col("c")), 1),
            "__b": F.array_min(F.transform(F.filter("__parts", lambda p: p["c"] != F.col("c")), mean_sq)),
        }
    )
    own_n = F.col("__own.n")
    inner = F.try_divide(mean_sq(F.col("__own")) * own_n, own_n - 1)
    width = F.when(own_n <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("__b") - inner, F.greatest(F.col("__b"), inner)), F.lit(0.0))
    )
    quality = scored.groupBy(*fit).agg(F.avg(width).alias("__q"))
    best = quality.groupBy(*grp).agg(F.max_by("k", F.struct(F.col("__q"), -F.col("k"))).alias("__k"))
    final_k = F.least(F.col("__k"), F.floor(F.col("__cells") / per_part).cast("int"))
    chosen = best.join(stats.select(*grp, "__cells"), grp).select(*grp, final_k.alias("k"))
    part = assigned.join(chosen, fit, "left_semi").select(*grp, "cell", (F.col("c") + 1).alias("part"))
    return df.join(part, [*grp, "cell"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
