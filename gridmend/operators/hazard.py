"""Storm exposure, fragility and damage draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalar
from ..functions.draws import normal, poisson, uniform
from .scratch import cut, erase, small

#: Fixed values of the fragility models. Substation states: lognormal (mu, sigma) in miles an hour, in rising order.
MPH = 2.23694
SUBSTATION = (("moderate", 5.068, 0.136), ("severe", 5.204, 0.147), ("complete", 5.523, 0.132))
#: Conductors, by angle of attack: two lognormal curves in metres a second, and the speed from which the first holds.
YAW = (0.0, 10.0, 20.0, 30.0, 40.0)
CONDUCTOR_HIGH = ((4.251, 4.266, 4.313, 4.398, 4.544), (0.0245, 0.0244, 0.0245, 0.0283, 0.0385))
CONDUCTOR_LOW = ((4.267, 4.282, 4.330, 4.414, 4.544), (0.0363, 0.0362, 0.0365, 0.0369, 0.0385))
CONDUCTOR_CUT = (68.0, 69.0, 72.0, 77.0, 0.0)
#: Wood poles of class 5: coefficients of 1, x, c, a, h, x2, cx, c2, xa, ca, a2, xh, ch, ah, h2 (x angle of attack,
#: c conductor area, a age, h height) for the mean and spread of the log speed in miles an hour.
POLE_MEAN = (6.597, -0.01285, -0.08189, 0.00685, -0.0654, 0.00004979, -0.001368, 0.005333, -0.0000007649, -0.000003429, -0.0001405, 0.0002438, 0.001743, -0.00001836, 0.0005301)
POLE_SPREAD = (0.1497, 0.0002763, 0.002362, -0.002293, 0.00006042, -0.0000005062, 0.000001237, -0.00007755, -0.000002332, -0.00002446, 0.00006829, -0.000004114, -0.00002209, 0.00001401, -0.0000002003)
POLE_AGE, POLE_HEIGHT, CONDUCTORS, CONDUCTOR_DIAMETER = 50.0, 12.0, 3.0, 0.011
SPAN_M = (30.0, 120.0)


def indexed_track(points: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Track points with their place in the given order, their category and their radius of maximum wind."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return points.withColumns({"time_index": place, "category": scalar.category(F.col("wind_kts")), "rmax_km": scalar.rmax_km(F.col("wind_kts"))})


def max_wind(points: DataFrame, tracks: DataFrame, case: list[str]) -> DataFrame:
    """(case, point_id, wind, eye_index): the highest wind at each point and the first eye position that brings it.

    ``tracks`` (case, time_index, lat, lon, speed, rmax_km) hold few points a storm. They are gathered into an array
    for each case, so that a point meets a storm once, not once for each hour of it.
    """
    eye = F.struct("time_index", "lat", "lon", "speed", "rmax_km")
    storms = tracks.groupBy(*case).agg(F.array_sort(F.collect_list(eye)).alias("track"))
    met = points.crossJoin(small(storms, 10_000))  # every point is exposed to every storm: that is the result's size

    def wind(e: Column) -> Column:
        km = scalar.haversine_km(F.col("lat"), F.col("lon"), e["lat"], e["lon"])
        speed = scalar.holland_wind(e["speed"], F.element_at("track", 1)["speed"], e["rmax_km"], km)
        return F.struct(speed.alias("wind"), (-e["time_index"]).alias("i"))

    best = F.array_max(F.transform("track", wind))
    return met.withColumn("best", best).select(*case, "point_id", F.col("best.wind").alias("wind"), (-F.col("best.i")).alias("eye_index"))


def substation_states(mph: Column) -> dict[str, Column]:
    """Probabilities of no, moderate, severe and complete damage; a state's is the difference of two curves."""
    reach = [scalar.lognormal_cdf(mph, mu, sigma) for _, mu, sigma in SUBSTATION]
    return {
        "p_none": 1 - reach[0],
        "p_moderate": F.greatest(F.lit(0.0), reach[0] - reach[1]),
        "p_severe": F.greatest(F.lit(0.0), reach[1] - reach[2]),
        "p_complete": reach[2],
    }


def conductor_failure(mps: Column, attack: Column) -> Column:
    """Failure of a transmission span; the angle counts up to 40 degrees."""
    x = F.least(attack, F.lit(40.0))
    at = lambda values: scalar.interpolate(x, YAW, values)
    high = mps >= at(CONDUCTOR_CUT)
    mu, sigma = (F.when(high, at(a)).otherwise(at(b)) for a, b in zip(CONDUCTOR_HIGH, CONDUCTOR_LOW, strict=True))
    return scalar.clip(scalar.normal_cdf((F.ln(F.greatest(mps, F.lit(1e-9))) - mu) / sigma), 0.0, 1.0)


def pole_failure(mps: Column, attack: Column, span_m: Column, height_m: float = POLE_HEIGHT) -> Column:
    """Failure of the pole that stands for an overhead segment of a representative span."""
    c, a, h, x = CONDUCTORS * CONDUCTOR_DIAMETER * scalar.clip(span_m, *SPAN_M), POLE_AGE, height_m, attack
    terms = (F.lit(1.0), x, c, F.lit(a), F.lit(h), x * x, c * x, c * c, x * a, c * a, F.lit(a * a), x * h, c * h, F.lit(a * h), F.lit(h * h))
    mu, beta = (sum((k * t for k, t in zip(values, terms, strict=True)), F.lit(0.0)) for values in (POLE_MEAN, POLE_SPREAD))
    return scalar.clip(scalar.normal_cdf((F.ln(F.greatest(mps * MPH, F.lit(1e-9))) - mu) / F.greatest(beta, F.lit(1e-6))), 0.0, 1.0)


def drawn_state(u: Column, p: dict[str, Column]) -> Column:
    """The state that a uniform number falls on."""
    out, total = None, F.lit(0.0)
    for name, prob in p.items():
        total = total + prob
        state = name.removeprefix("p_")
        out = F.when(u < total, state) if out is None else out.when(u < total, state)
    return out.otherwise(list(p)[-1].removeprefix("p_"))


def realised(probabilities: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """Which components (keys, p) fail in each of ``draws`` trials, without a shuffle."""
    each = probabilities.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = uniform(seed, *(F.col(k) for k in keys), F.col("trial"))
    return each.withColumn("u", u).withColumn("damaged", F.col("u") < F.col("p"))


def weighted_sample(items: DataFrame, by: list[str], weight: str, id_: str, n: Column, seed: int) -> DataFrame:
    """``n`` items of each group, drawn without replacement in proportion to weight: the largest u^(1/w)."""
    key = F.ln(uniform(seed, *(F.col(k) for k in (*by, id_)))) / F.col(weight)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(key), id_))
    return items.where(F.col(weight) > 0).withColumn("gm_place", place).where(F.col("gm_place") <= n).drop("gm_place")


#: Hours that the repair of a line takes, and mean and spread of those of a substation by its state.
LINE_HOURS, SUBSTATION_HOURS = (3.0, 5.0), {"severe": (168.0, 84.0), "complete": (720.0, 360.0)}


def repair_hours(damaged: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``damaged`` with the hours of repair by ``kind`` and ``state``: lines uniform, substations normal and not below 0."""
    key = [F.col(k) for k in keys]
    mean, spread = (F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, pair in SUBSTATION_HOURS.items() for x in (k, pair[i]))), F.col("state")), F.lit(0.0)) for i in (0, 1))
    low, high = LINE_HOURS
    line = low + (high - low) * uniform(seed, *key)
    return damaged.withColumn("repair_h", F.when(F.col("kind") == "line", line).otherwise(F.greatest(F.lit(0.0), mean + spread * normal(seed, *key))))


def extended_track(tracks: DataFrame, by: list[str], rate: float, step_km: float = 15.0, least_mps: float = 20.0, most: int = 200) -> DataFrame:
    """Further points of each track (by, time_index, lat, lon, speed) along its last heading until the wind is low.

    A closed form: speed falls by exp(-rate km) each step, so the number of steps is known at once.
    """
    order = W.partitionBy(*by).orderBy("time_index")
    last = tracks.withColumns({"dlat": F.col("lat") - F.lag("lat").over(order), "dlon": F.col("lon") - F.lag("lon").over(order)})
    last = last.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("time_index")))).where("place = 1")
    km = F.greatest(scalar.flat_distance_km(F.col("lat") - F.col("dlat"), F.col("lon") - F.col("dlon"), F.col("lat"), F.col("lon")), F.lit(1e-4))
    steps = F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.ln(F.col("speed") / least_mps) / (rate * step_km))))
    more = last.where(F.col("speed") > least_mps).withColumn("k", F.explode(F.sequence(F.lit(1), steps.cast("int"))))
    move = F.col("k") * step_km / km
    added = more.select(
        *by,
        (F.col("time_index") + F.col("k")).alias("time_index"),
        (F.col("lat") + F.col("dlat") * move).alias("lat"),
        (F.col("lon") + F.col("dlon") * move).alias("lon"),
        scalar.decayed(F.col("speed"), rate, F.col("k") * step_km).alias("speed"),
    )
    return tracks.select(*by, "time_index", "lat", "lon", "speed").unionByName(added)


#: Fixed values of the scenario sampler. Least MW that a scenario leaves dark, further draws until it does, and what each
#: adds in edges and in intensity.
LEAST_MW, RETRIES, MORE_EDGES, MORE_INTENSITY = 5.0, 3, 6, 0.05
#: How many edges: a Poisson number of mean base x intensity^1.7, and -2 to 4 more, within limits; scenarios that aren't
#: historical have at least 12 + 8 x intensity.
GROWTH, JITTER, LIMITS, AT_LEAST = 1.7, (-2, 4), (5, 42), (12.0, 8.0)
#: Which edges: near the storm by a bell curve of 34 + 8 x intensity km above a floor, length from 0.03 to 3.5 km.
VULNERABLE = {"transformer": 0.8, "switch": 0.5}
REACH_KM, FAR, LENGTH_KM, UNKNOWN_KM, LEAST_WEIGHT = (34.0, 8.0), 0.08, (0.03, 3.5), 0.1, 1e-8


def damage_targets(grid: DataFrame, seed: int) -> DataFrame:
    """``grid`` (scenario, intensity, base_mean, historical) with how many edges each scenario damages."""
    mean = F.col("base_mean") * F.pow("intensity", F.lit(GROWTH))
    first, last = JITTER
    drawn = poisson(mean, uniform(seed, F.col("scenario"), F.lit("edges"))) + F.floor(uniform(seed, F.col("scenario"), F.lit("jitter")) * (last - first + 1)) + first
    n = F.greatest(F.lit(LIMITS[0]), F.least(F.lit(LIMITS[1]), drawn))
    least = F.floor(AT_LEAST[0] + AT_LEAST[1] * F.col("intensity"))
    return grid.withColumn("target", F.when(F.col("historical"), n).otherwise(F.greatest(n, least)).cast("long"))


def edge_weight(km: Column, kind: Column, length_km: Column, intensity: Column) -> Column:
    """How likely a storm damages an edge: falls with distance, grows with the root of length and with intensity."""
    reach = REACH_KM[0] + REACH_KM[1] * intensity
    near = F.exp(-0.5 * F.pow(km / reach, F.lit(2.0)))
    vulnerable = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in VULNERABLE.items() for x in pair)), kind), F.lit(1.0))
    length = scalar.clip(F.coalesce(length_km, F.lit(UNKNOWN_KM)), *LENGTH_KM)
    return F.greatest((FAR + near) * vulnerable * F.sqrt(length) * intensity, F.lit(LEAST_WEIGHT))


def sampled_scenarios(grid: DataFrame, edges: DataFrame, power: DataFrame, seed: int) -> DataFrame:
    """(scenario, attempt, edge_id, node) of damaged edges of each scenario.

    ``grid``: scenario, lat, lon, shift_km, intensity, base_mean, historical; ``edges``: edge_id, node, lat, lon, kind,
    length_km; ``power``: node, kw. A draw that leaves less than LEAST_MW dark is repeated with more edges, RETRIES times
    at most; only scenarios that need it are drawn again. Every edge has a weight in every scenario, since the weight has
    a floor that no distance undercuts: edges x scenarios is the problem's size.
    """
    left = cut(damage_targets(grid, seed), "scenario-targets")
    taken = None
    for attempt in range(RETRIES + 1):
        asked = left.select("scenario", (F.col("target") + MORE_EDGES * attempt).alias("n"), F.col("lat").alias("eye_lat"), (F.col("lon") + F.col("shift_km") / 95.0).alias("eye_lon"), (F.col("intensity") + MORE_INTENSITY * max(0, attempt - 1)).alias("strength"))
        met = edges.crossJoin(small(asked)).withColumn("attempt", F.lit(attempt))
        km = scalar.haversine_km(F.col("eye_lat"), F.col("eye_lon"), F.col("lat"), F.col("lon"), "atan")
        weighed = met.withColumn("weight", edge_weight(km, F.col("kind"), F.col("length_km"), F.col("strength")))
        picked = cut(weighted_sample(weighed, ["scenario", "attempt"], "weight", "edge_id", F.col("n"), seed).select("scenario", "attempt", "edge_id", "node"), "scenario-edges")
        if attempt < RETRIES:
            dark = picked.select("scenario", "node").distinct().join(power, "node").groupBy("scenario").agg((F.sum("kw") / 1000).alias("mw")).where(F.col("mw") >= LEAST_MW)
            done = cut(dark.select("scenario"), "scenario-done")
            picked = picked.join(done, "scenario", "left_semi")
            rest = cut(left.join(done, "scenario", "left_anti"), "scenario-targets")
            erase(left)
            left = rest
        taken = picked if taken is None else taken.unionByName(picked)
        if not left.limit(1).count():
            break
    return taken
