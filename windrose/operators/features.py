"""Feature-row assembly: spread, atmospheric, ensemble, evolution and wind groups from the gridded state set.

The state set has one row per (init_time, lead_day, row_n, col_n): ``z`` (target level mean), ``z_std``, ``z700``,
``z850``, ``z700_std``, ``z850_std``, ``clim_value``, winds, pressure and their climatologies.  One region is one
grid position; multi-cell regions aggregate the output with ``regional_mean``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.functions import scalar as S
from windrose.operators import stencils as ST
from windrose.operators.alignment import previous_cycle

MAP = ["init_time", "lead_day"]
POSITION = ["init_time", "lead_day", "row_n", "col_n"]


def evolution(states: DataFrame, previous_init: Column, n_row: int, n_col: int) -> DataFrame:
    """Revision against the previous cycle valid at the same time: region |dz|, neighbourhood RMS dz, d spread, flag."""
    p = previous_cycle(states.select(*POSITION, "valid_time", "z", "z_std"), ["row_n", "col_n"], ["z", "z_std"], previous_init)
    d = p.withColumn("_dz", F.col("z") - F.col("prev_z"))
    nb = ST.neighbourhood_stats(d, "_dz", MAP, n_row, n_col, 1, "rev").select(*POSITION, F.col("rev_rms").alias("rev_nbhd"))
    return (d.join(nb, POSITION, "left").select(
        *POSITION, F.abs("_dz").alias("rev_region"), F.when(F.col("_dz").isNotNull(), F.col("rev_nbhd")).alias("rev_nbhd"),
        (F.col("z_std") - F.col("prev_z_std")).alias("rev_spread"), F.col("_dz").isNotNull().cast("int").alias("rev_available")))


def grid_features(states: DataFrame, n_row: int, n_col: int, dlat: float, dlon: float, first_lead: int,
                  previous_init: Column) -> DataFrame:
    """ATM, ENS (without member statistics) and EVO columns, one row per (init, lead, position)."""
    s = states.withColumns({
        "anom500": F.col("z") - F.col("clim_value"), "anom700": F.col("z700") - F.col("clim_value"),
        "anom850": F.col("z850") - F.col("clim_value")})
    s = s.withColumns({"thick_anom": F.col("anom500") - F.col("anom850"),
                       "abs_anom500": F.abs("anom500")})
    s = ST.gradients(s, "z", MAP, n_row, n_col, dlat, dlon, laplacian="lap500")
    s = ST.spread_growth(s, "z_std", ["init_time", "row_n", "col_n"], first_lead)
    s = ST.spread_relative_to_domain(s, "z_std")
    anom = ST.neighbourhood_stats(s, "anom500", MAP, n_row, n_col, 1, "a").select(*POSITION, F.col("a_mean").alias("nbhd_anom500"))
    spread = ST.neighbourhood_stats(s, "z_std", MAP, n_row, n_col, 1, "s").select(
        *POSITION, F.col("s_mean").alias("spread_nbhd"), (F.col("s_std") / F.greatest("s_mean", F.lit(1e-6))).alias("spread_hetero"))
    return (s.select(*POSITION, "anom500", "abs_anom500", "anom700", "anom850", "thick_anom", "grad_x", "grad_y", "grad_mag", "lap500",
                     F.col("z_std").alias("spread_m"), F.col("z700_std").alias("spread700"), F.col("z850_std").alias("spread850"),
                     "spread_growth", "domain_spread", "spread_rel_domain")
            .join(anom, POSITION, "left").join(spread, POSITION, "left").join(evolution(states, previous_init, n_row, n_col), POSITION, "left"))


def wind_features(states: DataFrame, n_row: int, n_col: int, dlat: float, dlon: float, first_lead: int, last_lead: int) -> DataFrame:
    """DYN columns: wind anomalies, speed, shear, vorticity, divergence, pressure, spreads, tendencies."""
    s = states.withColumns({
        "u500_anom": F.col("u") - F.col("u_clim"), "v500_anom": F.col("v") - F.col("v_clim"),
        "ws500": S.wind_speed("u", "v"), "ws850": S.wind_speed("u850", "v850"), "shear_500_850": S.vector_shear("u", "v", "u850", "v850"),
        "wspread500": S.vector_spread("u_std", "v_std"), "mslp_hpa": S.pa_to_hpa("mslp"),
        "mslp_anom": S.pa_to_hpa("mslp") - S.pa_to_hpa("mslp_clim"), "mslp_spread": S.pa_to_hpa("mslp_std")})
    s = ST.kinematics(s, {"500": ("u", "v"), "850": ("u850", "v850")}, MAP, n_row, n_col, dlat, dlon)
    s = ST.gradients(s, "mslp_hpa", MAP, n_row, n_col, dlat, dlon, prefix="_mslp").withColumnRenamed("_mslp_mag", "mslp_grad")
    s = ST.tendencies(s, {"z500_tend": "z", "mslp_tend": "mslp_hpa", "vort500_tend": "vort500"}, ["init_time", "row_n", "col_n"],
                      first_lead, last_lead)
    return s.select(*POSITION, "u500_anom", "v500_anom", "ws500", "ws850", "shear_500_850", "vort500", "vort850", "div500", "div850",
                    "mslp_anom", "mslp_grad", "wspread500", "mslp_spread", "z500_tend", "mslp_tend", "vort500_tend")


def regional_mean(features: DataFrame, bridge: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over the cells of each region."""
    return features.join(bridge, ["row_n", "col_n"]).groupBy("init_time", "lead_day", "region_id").agg(
        *[F.avg(c).alias(c) for c in columns])
