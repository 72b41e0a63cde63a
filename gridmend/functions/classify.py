"""Rules that put assets and customers into classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of fragility models by the kind of an edge that isn't an equivalent connection.
PHYSICAL = {"overhead_distribution_line": "legacy_pole_fragility_adapted_to_overhead_distribution_edge", "transmission_line": "legacy_conductor_fragility"}
UNSUPPORTED = {"underground_distribution_line": "unsupported_underground_line", "transformer": "unsupported_transformer", "switch": "unsupported_switch"}
PRIORITY = {"industrial_or_large_commercial": 2, "commercial": 3, "residential": 4}


def edge_component(kind: Column, role: Column, equivalent: Column, physical: Column, enabled: list[str]) -> Column:
    """(eligible, model) of an edge: only physical lines of enabled kinds can be damaged."""
    of = lambda eligible, model: F.struct(eligible.alias("eligible"), F.lit(model).alias("model"))
    out = F.when(F.coalesce(equivalent, F.lit(False)) | (role == "data_center_connection"), of(F.lit(False), "excluded_equivalent_connection"))
    for k, model in PHYSICAL.items():
        out = out.when((kind == k) & F.coalesce(physical, F.lit(False)), of(F.lit(k in enabled), model))
    for k, model in UNSUPPORTED.items():
        out = out.when(kind == k, of(F.lit(False), model))
    return out.otherwise(of(F.lit(False), "not_applicable"))


def node_component(substation: Column, kind: Column, data_center: Column, enabled: list[str]) -> Column:
    """(eligible, component, model) of a node."""
    of = lambda eligible, name, model: F.struct(F.lit(eligible).alias("eligible"), F.lit(name).alias("component"), F.lit(model).alias("model"))
    is_substation = F.coalesce(substation, F.lit(False)) | (F.lower(kind) == "substation_interface")
    out = F.when(is_substation, of("substation" in enabled, "substation", "legacy_substation_fragility"))
    out = out.when(F.coalesce(data_center, F.lit(False)), of(False, "data_center_facility", "excluded_data_center_facility"))
    return out.otherwise(of(False, "not_applicable", "not_applicable"))


def priority(load_type: Column, critical: Column, data_center: Column) -> Column:
    """0 for data centres, 1 for critical loads, then by type; 5 for what isn't known."""
    out = F.when(data_center, 0).when(critical, 1)
    for k, n in PRIORITY.items():
        out = out.when(load_type == k, n)
    return out.otherwise(5)


def customer_class(profile: Column, name: Column) -> Column:
    t = F.lower(F.concat_ws(" ", F.coalesce(profile, F.lit("")), F.coalesce(name, F.lit(""))))
    named = lambda tag: t.startswith(tag) | t.contains(f" {tag}")
    large = t.rlike("ind_|industrial|lgcom|large")
    return F.when(t.contains("critical"), "critical").when(named("res_"), "residential").when(named("com_"), "commercial").when(large, "industrial_or_large_commercial").otherwise("unknown")


def installation(code: Column) -> tuple[Column, Column]:
    """(overhead, underground) by a line code; null without one."""
    t = F.when(F.length(code) > 0, F.upper(code))
    return t.contains("OH"), t.contains("UG") | t.contains("UDG")


def candidate_score(coast_km: Column, kv: Column, feeders: Column, nodes: Column, peak_mw: Column, raw_nodes: Column, lat: Column, lon: Column, preferred: tuple[int, int], least: int, hard_most: int) -> Column:
    """The weighted score of a candidate region."""
    low, high = preferred
    near = F.when(coast_km <= 80, 3.0).when(coast_km <= 150, 2.0).when(coast_km <= 250, 1.0).otherwise(0.0)
    voltage = F.when(kv.isin(69.0, 138.0), 2.0).otherwise(0.0)
    mapped = F.when(feeders >= 2, 2.0).when(feeders == 1, 1.0).otherwise(0.0)
    size = F.when(nodes.between(low, high), 3.0).when(nodes >= least, 2.0).when(nodes >= 100, 0.5).otherwise(0.0)
    load = F.when(peak_mw >= 80, 2.0).when(peak_mw >= 30, 1.0).otherwise(0.0)
    large = F.when(raw_nodes > hard_most * 3, -2.0).when(raw_nodes > high * 3, -1.0).otherwise(0.0)
    placed = lambda x: x.isNotNull() & ~F.isnan(x)
    lost = F.when(placed(lat) & placed(lon), 0.0).otherwise(-3.0)
    return F.round(near + voltage + mapped + size + load + large + lost, 3)


def region_of(lat: Column, lon: Column, boxes: dict[str, tuple[float, float, float, float]], margin: float = 0.0) -> Column:
    """The first box (south, west, north, east) that a point lies in, else the first widened one, marked so."""
    inside = lambda b, m: lat.between(b[0] - m, b[2] + m) & lon.between(b[1] - m, b[3] + m)
    strict = F.coalesce(*(F.when(inside(b, 0.0), F.lit(k)) for k, b in boxes.items()), F.lit(None))
    wide = F.coalesce(*(F.when(inside(b, margin), F.lit(f"{k}_expanded")) for k, b in boxes.items()), F.lit(None))
    return F.coalesce(strict, wide)
