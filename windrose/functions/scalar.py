"""Row-local column expressions: time, calendar, geometry, labels, risk and priority rules.

All of them are plain Catalyst expressions, so they stay inside whole-stage codegen and never add a shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrose import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    """NaN and infinities become NULL, the only missing-value marker used by the library."""
    x = _c(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clip(x, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp that keeps NULL (``least``/``greatest`` alone skip NULL arguments and would invent a bound)."""
    x = _c(x)
    y = x if lo is None else F.greatest(x, F.lit(float(lo)))
    y = y if hi is None else F.least(y, F.lit(float(hi)))
    return F.when(x.isNotNull(), y)


# --- time and calendar -----------------------------------------------------------------------------------

def lead_to_hours(lead) -> Column:
    """Day-time interval lead -> integer hours."""
    return (F.expr(f"cast(extract(DAY from {lead}) as int)") * 24
            + F.expr(f"cast(extract(HOUR from {lead}) as int)")).cast("int")


def valid_time(init, lead_hours) -> Column:
    """Verification time of a forecast: init + lead."""
    return _c(init) + F.make_dt_interval(F.lit(0), _c(lead_hours))


def lead_day(lead_hours) -> Column:
    """Whole-day lead; a lead that is not a whole number of days is an error, never rounded."""
    h = _c(lead_hours)
    return F.when(h % 24 != 0, F.raise_error(F.concat(F.lit("lead is not a whole day: "), h.cast("string"))).cast("int")
                  ).otherwise((h / 24).cast("int"))


def season(time, seasons: dict[str, tuple[int, ...]] | None = None) -> Column:
    month = F.month(_c(time))
    branches = [(month.isin(*months), name) for name, months in (seasons or C.SEASONS).items()]
    return reduce(lambda acc, b: acc.when(b[0], b[1]), branches[1:], F.when(*branches[0]))


def season_code(season_col, codes: dict[str, int] | None = None) -> Column:
    codes = codes or C.SEASON_CODES
    s = _c(season_col)
    names = list(codes)
    out = F.when(s == names[0], codes[names[0]])
    for n in names[1:]:
        out = out.when(s == n, codes[n])
    return out.cast("int")


def split_of(time, periods: dict[str, tuple[str, str]]) -> Column:
    """Chronological split by closed init intervals; a later entry wins where intervals overlap."""
    t = _c(time)
    out = F.lit("unused")
    for name, (lo, hi) in periods.items():
        out = F.when(t.between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")), name).otherwise(out)
    return out


def embargo(split, valid, period_ends: dict[str, str]) -> Column:
    """Rows of a fitting period that verify after its end carry the next period's truth: purge them."""
    s, v = _c(split), _c(valid)
    late = reduce(lambda a, b: a | b,
                  [(s == name) & (v > F.lit(end).cast("timestamp")) for name, end in period_ends.items()])
    return F.when(late, "embargo").otherwise(s)


def case_id(init, region, lead) -> Column:
    return F.concat_ws("_", F.date_format(_c(init), "yyyyMMddHH"), _c(region),
                       F.concat(F.lit("D"), F.lpad(_c(lead).cast("string"), 2, "0")))


def region_code(row, col) -> Column:
    return (_c(row) * 100 + _c(col)).cast("int")


# --- geometry --------------------------------------------------------------------------------------------

def in_box(lat, lon, box: dict[str, float]) -> Column:
    """Inclusive latitude/longitude box (pushed down to the scan)."""
    return _c(lat).between(box["lat_min"], box["lat_max"]) & _c(lon).between(box["lon_min"], box["lon_max"])


def area_tag(lat, lon) -> Column:
    """First matching descriptive box; boxes overlap, so the order of the table is part of the rule."""
    la, lo = _c(lat), _c(lon)
    out = F
    for name, (a0, a1), (o0, o1) in C.AREA_TAGS:
        out = out.when((la >= a0) & (la < a1) & (lo >= o0) & (lo < o1), name)
    return out.otherwise(C.AREA_TAG_DEFAULT)


def area_weight(lat, spacing) -> Column:
    """Exact relative area of a latitude box, clipped at the poles."""
    la = _c(lat)
    d = _c(spacing) if isinstance(spacing, (str, Column)) else F.lit(float(spacing))
    top = F.least(F.lit(90.0), la + d / 2)
    bottom = F.greatest(F.lit(-90.0), la - d / 2)
    return F.sin(F.radians(top)) - F.sin(F.radians(bottom))


def to_metres(geopotential) -> Column:
    return _c(geopotential) / C.STANDARD_GRAVITY


def canonical_geopotential(value, units) -> Column:
    """Heights become geopotential (m2 s-2); unknown units are an error."""
    v, u = _c(value), _c(units)
    return (F.when(u.isin(*C.HEIGHT_UNITS), v * C.STANDARD_GRAVITY)
            .when(u.isin(*C.GEOPOTENTIAL_UNITS), v)
            .otherwise(F.raise_error(F.concat(F.lit("unsupported geopotential units: "), F.coalesce(u, F.lit("NULL"))))
                       .cast("double")))


def wrap_longitude(lon) -> Column:
    return F.pmod(_c(lon), F.lit(360.0))


# --- labels ----------------------------------------------------------------------------------------------

def normalized_error(error, scale) -> Column:
    s = _c(scale)
    return F.when(s > 0, _c(error) / s).when(s.isNull(), None).otherwise(
        F.raise_error(F.lit("normalisation scale must be positive")).cast("double"))


def spread_threshold_ratio(spread, q_primary, scale, n_members) -> Column:
    m = _c(n_members) if isinstance(n_members, (str, Column)) else F.lit(float(n_members))
    return _c(spread) * F.sqrt(1 + 1 / m) / (_c(q_primary) * _c(scale))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


# --- risk, evidence, priority ------------------------------------------------------------------------------

def risk_level(p, p_clim, threshold) -> Column:
    t = _c(threshold) if isinstance(threshold, (str, Column)) else F.lit(float(threshold))
    return (F.when(_c(p) >= t, "ALERT").when(_c(p) > _c(p_clim), "ABOVE CLIMATOLOGY")
            .otherwise("AT OR BELOW CLIMATOLOGY"))


def criterion_level(rate, clim, n, kmin: int) -> Column:
    r, c, k = _c(rate), _c(clim), _c(n)
    return (F.when(r.isNull() | k.isNull() | (k < kmin), "INSUFFICIENT")
            .when(r >= 2 * c, "HIGH").when(r > 1.25 * c, "ELEVATED").otherwise("NORMAL"))


def evidence_strength(support_level, n_within, rate, p, kmin: int) -> Column:
    """0 strong .. 3 insufficient.  Insufficient overrides strong, strong overrides moderate."""
    s, n = _c(support_level), F.coalesce(_c(n_within), F.lit(0))
    agree = F.coalesce(F.abs(_c(rate) - _c(p)) <= 0.25, F.lit(False))
    return (F.when((s >= 3) | (n < kmin), 3)
            .when((s == 0) & (n >= 4 * kmin) & agree, 0)
            .when((s <= 1) & (n >= 2 * kmin), 1)
            .otherwise(2)).cast("int")


def _urgency(lead, halflife: float) -> Column:
    return F.pow(F.lit(0.5), (_c(lead) - 1) / F.lit(halflife))


def _evidence_weight(level) -> Column:
    out = F
    for i, w in enumerate(C.EVIDENCE_WEIGHTS):
        out = out.when(_c(level) == i, w)
    return out


def priority_score(p, lead, evidence, bonus: Column | None = None,
                   halflife: float = C.URGENCY_HALFLIFE_DAYS) -> Column:
    """p x urgency(lead) x evidence weight, plus an optional additive bonus column."""
    base = _c(p) * _urgency(lead, halflife) * _evidence_weight(evidence)
    return base if bonus is None else base + bonus


def disagreement_bonus(p, p_base, b: float = C.DISAGREEMENT_BONUS) -> Column:
    return F.lit(b) * clip(_c(p) - _c(p_base), 0.0)


def tail_bonus(upper, threshold, b: float = C.DISAGREEMENT_BONUS) -> Column:
    return F.lit(b) * clip(_c(upper) / _c(threshold) - 1, 0.0, 1.0)


def round_or_null(x, digits: int = 4) -> Column:
    return F.round(nan_to_null(x), digits)


# --- fields ------------------------------------------------------------------------------------------------

def wind_speed(u, v) -> Column:
    return F.hypot(_c(u), _c(v))


def vector_shear(u1, v1, u2, v2) -> Column:
    return F.hypot(_c(u1) - _c(u2), _c(v1) - _c(v2))


def vector_spread(su, sv) -> Column:
    return F.sqrt(_c(su) * _c(su) + _c(sv) * _c(sv))


def pa_to_hpa(x) -> Column:
    return _c(x) / 100.0


KM_PER_DEGREE = math.radians(1.0) * C.EARTH_RADIUS_KM
