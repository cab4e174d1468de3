"""Metric registries of the experiment kinds. A metric is data: columns, aggregate names and SQL predicates."""

from __future__ import annotations

from dataclasses import replace

from ..operators.metrics import Agg, ExperimentSpec, Metric

ACCEPTED = "is_ar"
COMPLETED = ("picked_up", "is_cp", "is_ar")
GEO = "is_geo_trip"
THIS_WEEK = ("retro = 'tw'",)
FIRST = "rn = 1"


def _geo(name, x, y, where=THIS_WEEK, split_col=None):
    return Metric(name, x, y, Agg("driver_id", "nunique"), where, split_col=split_col)


def _orders(*where):
    return Agg("order_id", "nunique", where)


def _drivers(*where):
    return Agg("driver_id", "nunique", where)


GEO_METRICS = (
    _geo("o2r", _orders(*COMPLETED), _orders()),
    _geo("ar", _orders(ACCEPTED), _orders()),
    _geo("of2r", _orders(*COMPLETED), Agg("offer_id", "nunique")),
    _geo("gtpd", _orders(GEO, *COMPLETED), _drivers()),
    _geo("gtpgd", _orders(GEO, *COMPLETED), _drivers(GEO, ACCEPTED, "picked_up")),
    _geo("tpgd", _orders("is_geo_driver", *COMPLETED), _drivers(GEO, ACCEPTED)),
    _geo("rr", _drivers(GEO, ACCEPTED), _drivers()),
    _geo("sh_per_driver", Agg("supply_sec", "sum_hours", (*COMPLETED, FIRST)), _drivers()),
    _geo("cpt", Agg("damage", "sum", (*COMPLETED, FIRST)), _orders(*COMPLETED)),
    _geo("o2r_wow", _orders(*COMPLETED), _orders(), (), "retro"),
)
GEO_TOTALS = {
    "drivers": _drivers(*THIS_WEEK),
    "drivers_is_geo": _drivers(GEO, ACCEPTED, *THIS_WEEK),
    "orders": _orders(*THIS_WEEK),
    "accepted_orders": _orders(ACCEPTED, *THIS_WEEK),
    "trips": _orders(*COMPLETED, *THIS_WEEK),
    "trips_geominimal": _orders(GEO, *COMPLETED, *THIS_WEEK),
    "suggests": Agg("offer_id", "nunique", THIS_WEEK),
    "cost": Agg("damage", "sum", (*COMPLETED, FIRST, *THIS_WEEK)),
    "sh": Agg("supply_sec", "sum_hours", (*COMPLETED, FIRST, *THIS_WEEK)),
}
# Buffer-zone ratios; they need the flag in_buffer (operators.polygons.in_surrounding_area).
BUFFER_METRICS = (
    _geo("o2r_cnbl", _orders("in_buffer", *COMPLETED), _orders("in_buffer")),
    _geo("of2r_cnbl", _orders("in_buffer", *COMPLETED), Agg("offer_id", "nunique", ("in_buffer",))),
)
GEO_EXPERIMENT = ExperimentSpec("split", "driver_id", GEO_METRICS, GEO_TOTALS, 0.95, 1000, 500, 1000)
# Facts of the polygons and of the area around them: the usual figures inside, the buffer ratios outside.
GEO_AREA_EXPERIMENT = replace(
    GEO_EXPERIMENT, metrics=(*(replace(m, where=(*m.where, "in_polygon")) for m in GEO_METRICS), *BUFFER_METRICS),
    totals={k: a.narrowed(("in_polygon",)) for k, a in GEO_TOTALS.items()},
)


def _ladder(name, x, y):
    return Metric(name, Agg(x, "sum"), y, Agg("driver_id", "nunique"))


LADDER_EXPERIMENT = ExperimentSpec(
    "split", "driver_id",
    (
        _ladder("tpd", "orders_count", Agg("driver_id", "nunique")),
        _ladder("average_bill", "driver_bill", Agg("orders_count", "sum")),
        _ladder("cpt", "fee", Agg("orders_count", "sum")),
    ),
    {
        "drivers": Agg("driver_id", "nunique"), "trips": Agg("orders_count", "sum"), "gmv": Agg("driver_bill", "sum"),
        "payments": Agg("expected_sum", "sum"), "costs": Agg("fee", "sum"),
    },
    0.99, 1000, 100, 100,
)


def _discount(name, x, y):
    return Metric(name, Agg(x, "sum"), y if isinstance(y, Agg) else Agg(y, "sum"), Agg("id_client", "nunique"), estimator="ttest_ratio")


DISCOUNT_EXPERIMENT = ExperimentSpec(
    "split", "id_client",
    (
        _discount("o2r", "rides", "orders"),
        _discount("v2r", "rides", "views"),
        _discount("v2o", "orders", "views"),
        _discount("cpt", "sale_part_ride", "rides"),
        _discount("tpc", "rides", Agg("id_client", "nunique")),
    ),
    {
        "clients": Agg("id_client", "nunique"), "views": Agg("views", "sum"), "orders": Agg("orders", "sum"),
        "rides": Agg("rides", "sum"), "bill": Agg("client_bill", "sum"), "discount": Agg("sale_part_ride", "sum"),
    },
    0.95, 1000, 500, 1000,
)

# Driver A/B set: name -> (kind, numerator column, denominator column or None, breakdowns).
DRIVER_METRICS = {
    "AR": ("binomial", "accept", None, ("Total", "chain", "distance")),
    "RR": ("binomial", "reject", None, ("Total", "chain", "distance")),
    "FR": ("binomial", "fraud", None, ("Total", "chain", "distance")),
    "churn_7day": ("binomial", "churn_7day", None, ("Total",)),
    "churn_14day": ("binomial", "churn_14day", None, ("Total",)),
    "churn_21day": ("binomial", "churn_21day", None, ("Total",)),
    "MPH_gross": ("ratio", "money_gross", "supply_hours", ("Total", "park", "brand", "segment")),
    "MPH_net": ("ratio", "money_net", "supply_hours", ("Total", "park", "brand", "segment")),
    "MPH_organic_gross": ("ratio", "organic_money_gross", "supply_hours", ("Total", "park", "brand", "segment")),
    "MPH_organic_net": ("ratio", "organic_money_net", "supply_hours", ("Total", "park", "brand", "segment")),
    "SHpD": ("ratio", "supply_hours", "drivers", ("Total", "park", "brand", "segment")),
    "DE": ("ratio", "on_trip", "supply_hours", ("Total", "park", "brand", "segment")),
    "TPD": ("ratio", "trips", "drivers", ("Total", "park", "brand", "segment")),
    "OF2R": ("ratio", "rides", "offers", ("Total",)),
    "GMVPT": ("ratio", "gmv", "rides", ("Total",)),
    "COPT": ("ratio", "contribution", "rides", ("Total",)),
    "DIPT": ("ratio", "di", "rides", ("Total",)),
    "COMPT": ("ratio", "commission", "rides", ("Total",)),
    "exp_dist_mean": ("continuous", "exp_dist_km", None, ("Total",)),
    "exp_dist_median": ("continuous_median", "exp_dist_km", None, ("Total",)),
}
DRIVER_ALPHA, DRIVER_POWER = 0.01, 0.9
GOAL_ALPHA, GOAL_POWER = 0.01, 0.8
