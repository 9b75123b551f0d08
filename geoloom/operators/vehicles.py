"""What a vehicle's profile and the scenario's parameters say: smoothing options, turn space, success of curves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.scalar import clamp

#: What holds where neither profile nor parameters say otherwise, and the bounds of turn space in metres.
DEFAULTS = {"fixed_wing_speed_mps": 250.0, "rotorcraft_speed_mps": 100.0, "fixed_wing_turn_radius_m": 5_000.0, "rotorcraft_turn_radius_m": 0.0, "max_bank_deg": 30.0, "max_climb_angle_deg": 15.0}
GRAVITY, LEAST_SPACE_M, MOST_SPACE_M = 9.81, 2_000.0, 10_000.0


def smooth_options(profiles: DataFrame, defaults: Mapping[str, float] = DEFAULTS) -> DataFrame:
    """``profiles`` (aircraft_type, cruise_speed_mps, speed_low, speed_high, max_bank_deg, min_turn_radius_m,
    max_climb_angle_deg; null where not given) with speed_mps, turn_radius_m, max_climb_deg and least_radius_m: the
    radius that physics asks for at cruise, or the planned one if that is smaller."""
    fixed = F.col("aircraft_type") == "FIXED_WING"
    by_type = lambda name: F.when(fixed, F.lit(defaults[f"fixed_wing_{name}"])).otherwise(F.lit(defaults[f"rotorcraft_{name}"]))
    p = profiles.withColumn("speed_mps", F.coalesce("cruise_speed_mps", (F.col("speed_low") + F.col("speed_high")) / 2, by_type("speed_mps")))
    p = p.withColumn("turn_radius_m", F.coalesce("min_turn_radius_m", by_type("turn_radius_m")))
    p = p.withColumn("max_climb_deg", F.coalesce("max_climb_angle_deg", F.lit(defaults["max_climb_angle_deg"])))
    bank = F.coalesce("max_bank_deg", F.lit(defaults["max_bank_deg"]))
    return p.withColumn("least_radius_m", F.least(F.col("speed_mps") * F.col("speed_mps") / (GRAVITY * F.tan(F.radians(bank))), F.col("turn_radius_m")))


def turn_space(radius_m: Column) -> Column:
    """Metres by which walls grow for the turns of one vehicle."""
    return clamp(radius_m * 0.5, LEAST_SPACE_M, MOST_SPACE_M)


def widest_turn_space(options: DataFrame, key: str) -> DataFrame:
    """For each ``key`` the largest turn space of its vehicles."""
    return options.groupBy(key).agg(F.max(turn_space(F.col("turn_radius_m"))).alias("inflation_m"))


def curve_success(curves: DataFrame, *keys: str) -> DataFrame:
    """Of curves (``length``, null where none was found): n_ok, n_all and the mean length of those found, 0 without any."""
    return curves.groupBy(*keys).agg(F.count("length").alias("n_ok"), F.count("*").alias("n_all"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"))
