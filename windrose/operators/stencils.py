"""Finite-difference and neighbourhood operators on long-form grids.

A field is rows (map keys, row_n, col_n, value...).  Differences use ``lag``/``lead`` along one axis; a neighbour
counts only when its position is adjacent, so absent cells give NULL instead of a wrong difference.  Partitions
are single grid lines or single forecasts, whose length is fixed by the grid and the lead set.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.operators.grid import box_sums

FLAT = 1e-12      # relative variance below which a field counts as flat


class Axis:
    """Adjacent values along one axis of a map: ``pos`` runs over first..last within the partition ``by``."""

    def __init__(self, by: Sequence[str], pos: str, first: int, last: int):
        self.w, self.pos, self.first, self.last = W.partitionBy(*by).orderBy(pos), pos, first, last

    def before(self, c: Column) -> Column:
        return F.when(F.lag(self.pos).over(self.w) == F.col(self.pos) - 1, F.lag(c).over(self.w))

    def after(self, c: Column) -> Column:
        return F.when(F.lead(self.pos).over(self.w) == F.col(self.pos) + 1, F.lead(c).over(self.w))

    def gradient(self, c: Column) -> Column:
        """Centred difference inside, one-sided at the two ends of the axis."""
        return (F.when(F.col(self.pos) == self.first, self.after(c) - c)
                .when(F.col(self.pos) == self.last, c - self.before(c))
                .otherwise((self.after(c) - self.before(c)) / 2))

    @property
    def edge(self) -> Column:
        return (F.col(self.pos) == self.first) | (F.col(self.pos) == self.last)


def grid_axes(by: Sequence[str], n_row: int, n_col: int) -> tuple[Axis, Axis]:
    """(along longitude, along latitude)."""
    return Axis([*by, "row_n"], "col_n", 0, n_col - 1), Axis([*by, "col_n"], "row_n", 0, n_row - 1)


def gradients(df: DataFrame, value: str, by: Sequence[str], n_row: int, n_col: int, dlat: float, dlon: float,
              prefix: str = "grad", laplacian: str | None = None) -> DataFrame:
    """Gradients per 100 km (``prefix``_x, _y, _mag) and optionally the 5-point Laplacian (NULL on edges)."""
    x, y = grid_axes(by, n_row, n_col)
    z = F.col(value)
    dx = F.cos(F.radians("lat")) * (math.radians(dlon) * C.EARTH_RADIUS_KM)
    dy = math.radians(dlat) * C.EARTH_RADIUS_KM
    cols = {f"{prefix}_x": x.gradient(z) / dx * 100}
    if laplacian:
        cols["_lap_x"] = F.when(~x.edge, x.before(z) + x.after(z))
    out = df.withColumns(cols)
    cols = {f"{prefix}_y": y.gradient(z) / dy * 100}
    if laplacian:
        cols[laplacian] = F.when(~y.edge, F.col("_lap_x") + y.before(z) + y.after(z) - 4 * z)
    return out.withColumns(cols).withColumn(f"{prefix}_mag", F.hypot(f"{prefix}_x", f"{prefix}_y")).drop("_lap_x")


def kinematics(df: DataFrame, winds: Mapping[str, tuple[str, str]], by: Sequence[str], n_row: int, n_col: int, dlat: float,
               dlon: float) -> DataFrame:
    """Relative vorticity and divergence (1e-5 s-1) on the sphere for each suffix -> (u, v); NULL on edges."""
    x, y = grid_axes(by, n_row, n_col)
    cos = F.cos(F.radians("lat"))
    dlam, dphi = math.radians(dlon), math.radians(dlat)
    along_x, along_y, final, drop = {}, {}, {}, []
    for s, (u, v) in winds.items():
        along_x[f"_vx{s}"] = F.when(~x.edge, x.gradient(F.col(v)) / dlam)
        along_x[f"_ux{s}"] = F.when(~x.edge, x.gradient(F.col(u)) / dlam)
        along_y[f"_uy{s}"] = F.when(~y.edge, y.gradient(F.col(u) * cos) / dphi)
        along_y[f"_vy{s}"] = F.when(~y.edge, y.gradient(F.col(v) * cos) / dphi)
        final[f"vort{s}"] = (F.col(f"_vx{s}") - F.col(f"_uy{s}")) / (cos * C.EARTH_RADIUS_M) * 1e5
        final[f"div{s}"] = (F.col(f"_ux{s}") + F.col(f"_vy{s}")) / (cos * C.EARTH_RADIUS_M) * 1e5
        drop += [f"_vx{s}", f"_ux{s}", f"_uy{s}", f"_vy{s}"]
    return df.withColumns(along_x).withColumns(along_y).withColumns(final).drop(*drop)


def tendencies(df: DataFrame, fields: Mapping[str, str], by: Sequence[str], first_lead: int, last_lead: int,
               lead: str = "lead_day") -> DataFrame:
    """|d/dt| per lead step along each forecast (out name -> field)."""
    t = Axis(by, lead, first_lead, last_lead)
    return df.withColumns({out: F.abs(t.gradient(F.col(c))) for out, c in fields.items()})


def neighbourhood_stats(df: DataFrame, value: str, by: Sequence[str], n_row: int, n_col: int, half: int = 1,
                        prefix: str = "nbhd") -> DataFrame:
    """Mean, population std and RMS over the clipped box around each position."""
    v = F.col(value)
    ok = v.isNotNull()
    s = box_sums(df, by, {"_n": ok.cast("int"), "_s": F.when(ok, v).otherwise(0.0), "_q": F.when(ok, v * v).otherwise(0.0)},
                 half, n_row, n_col)
    mean, sq = F.col("_s") / F.col("_n"), F.col("_q") / F.col("_n")
    var = F.greatest(sq - mean * mean, F.lit(0.0))
    return s.where(F.col("_n") > 0).select(
        *by, "row_n", "col_n", mean.alias(f"{prefix}_mean"),
        F.when(var > FLAT * sq, F.sqrt(var)).otherwise(0.0).alias(f"{prefix}_std"), F.sqrt(sq).alias(f"{prefix}_rms"),
        F.col("_n").alias(f"{prefix}_n"))


def _weighted_moments(df: DataFrame, f: Column, a: Column, weight: Column, by, n_row, n_col, half) -> DataFrame:
    ok = f.isNotNull() & a.isNotNull()
    m = {"_n": ok.cast("int"), "_w": weight, "_wf": weight * f, "_wa": weight * a, "_wff": weight * f * f,
         "_waa": weight * a * a, "_wfa": weight * f * a}
    s = box_sums(df.where(ok), by, m, half, n_row, n_col)
    mf, ma = F.col("_wf") / F.col("_w"), F.col("_wa") / F.col("_w")
    vf = F.greatest(F.col("_wff") / F.col("_w") - mf * mf, F.lit(0.0))
    va = F.greatest(F.col("_waa") / F.col("_w") - ma * ma, F.lit(0.0))
    s = s.withColumns({"mf": mf, "ma": ma, "cov": F.col("_wfa") / F.col("_w") - mf * ma,
                       "vf": F.when(vf > FLAT * F.col("_wff") / F.col("_w"), vf).otherwise(0.0),
                       "va": F.when(va > FLAT * F.col("_waa") / F.col("_w"), va).otherwise(0.0)})
    return s.select(*by, "row_n", "col_n", "_n", "mf", "ma", "vf", "va", "cov")


def failure_signature(df: DataFrame, forecast: str, analysis: str, weight: Column, by: Sequence[str], n_row: int, n_col: int,
                      half: int = 3, dominance: float = C.SIGNATURE_DOMINANCE, centre: float = 0.0) -> DataFrame:
    """Murphy decomposition of the window MSE into bias, amplitude and phase terms, and the dominating class.

    ``centre`` (for example a mean geopotential height) is subtracted from both fields before the moments are
    formed; the decomposition does not depend on it, the numerical accuracy does."""
    m = _weighted_moments(df, F.col(forecast) - centre, F.col(analysis) - centre, weight, by, n_row, n_col, half)
    sf, sa = F.sqrt("vf"), F.sqrt("va")
    m = m.withColumn("sig_corr", F.when((F.col("vf") > 0) & (F.col("va") > 0), F.col("cov") / (sf * sa)).otherwise(1.0))
    phase = 2 * sf * sa * (1 - F.col("sig_corr"))
    bias = F.col("mf") - F.col("ma")
    m = m.withColumns({"sig_bias_m": bias, "_phase": phase, "sig_mse": bias * bias + (sf - sa) * (sf - sa) + phase})
    m = m.withColumn("sig_phase_share", F.when(F.col("sig_mse") > 0, F.col("_phase") / F.col("sig_mse")).otherwise(0.0))
    m = m.withColumn("sig_amp_share", 1 - F.col("sig_phase_share"))
    pos, amp, mixed = C.SIGNATURE_CLASSES
    cls = F.when(F.col("sig_phase_share") >= dominance, pos).when(F.col("sig_amp_share") >= dominance, amp).otherwise(mixed)
    return m.select(*by, "row_n", "col_n", cls.alias("sig_class"), "sig_phase_share", "sig_amp_share", "sig_bias_m", "sig_corr",
                    "sig_mse")


def local_correlation(df: DataFrame, forecast_anomaly: str, reference_anomaly: str, weight: Column, by: Sequence[str], n_row: int,
                      n_col: int, half: int = 1) -> DataFrame:
    """Centred weighted anomaly correlation over the full (2 half + 1)^2 window; NULL if incomplete or flat."""
    m = _weighted_moments(df, F.col(forecast_anomaly), F.col(reference_anomaly), weight, by, n_row, n_col, half)
    full = F.col("_n") == (2 * half + 1) ** 2
    r = F.col("cov") / F.sqrt(F.col("vf") * F.col("va"))
    return m.select(*by, "row_n", "col_n", F.when(full & (F.col("vf") > 0) & (F.col("va") > 0), r).alias("local_acc"))


def spread_growth(df: DataFrame, spread: str, by: Sequence[str], first_lead: int, lead: str = "lead_day",
                  out: str = "spread_growth") -> DataFrame:
    """Spread relative to the first lead of the same forecast."""
    first = F.max(F.when(F.col(lead) == first_lead, F.col(spread))).over(W.partitionBy(*by))
    return df.withColumn(out, F.col(spread) / F.when(first.isNotNull(), F.greatest(first, F.lit(1e-6))))


def spread_relative_to_domain(df: DataFrame, spread: str, by: Sequence[str] = ("init_time", "lead_day")) -> DataFrame:
    domain = F.sqrt(F.avg(F.col(spread) * F.col(spread)).over(W.partitionBy(*by)))
    return (df.withColumn("domain_spread", domain)
            .withColumn("spread_rel_domain", F.when(F.col("domain_spread").isNotNull(),
                                                    F.col(spread) / F.greatest("domain_spread", F.lit(1e-6)))))
