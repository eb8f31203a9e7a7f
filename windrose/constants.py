"""Fixed values of the domain: units, calendars, label rules, feature groups and display names.

Everything in this module is data, not logic.  The values are part of the result contract (a changed
season table or evidence weight changes results), so they are stated literally and in natural order.
"""

from __future__ import annotations

# --- units and geometry (fixed values) -----------------------------------------------------------
STANDARD_GRAVITY = 9.80665          # m s-2, geopotential <-> geopotential height
EARTH_RADIUS_KM = 6371.0
EARTH_RADIUS_M = 6.371e6
GEOPOTENTIAL_UNITS = ("m**2 s**-2", "m2 s-2", "m^2/s^2")
HEIGHT_UNITS = ("gpm", "m")

# --- forecast layout (fixed values) ----------------------------------------------------------------
LEAD_HOURS = (24, 48, 72, 96, 120, 144, 168, 192, 216, 240)
LEVELS = (500, 700, 850)
TARGET_LEVEL = 500
TARGET_DOMAIN = {"lat_min": -5.0, "lat_max": 40.0, "lon_min": 60.0, "lon_max": 105.0}
CONTEXT_DOMAIN = {"lat_min": -31.0, "lat_max": 65.0, "lon_min": 22.0, "lon_max": 147.0}
MIN_MEMBERS = 10

# --- seasons by calendar month (fixed values) ------------------------------------------------------
SEASONS = {"JF": (1, 2), "MAM": (3, 4, 5), "JJAS": (6, 7, 8, 9), "OND": (10, 11, 12)}
SEASON_CODES = {"JF": 0, "MAM": 1, "JJAS": 2, "OND": 3}

# --- descriptive area boxes, first match wins: (name, [lat_lo, lat_hi), [lon_lo, lon_hi)) -----------
AREA_TAGS = (
    ("Arabian Sea", (5.0, 22.0), (55.0, 72.0)),
    ("Bay of Bengal", (5.0, 22.0), (80.5, 95.0)),
    ("Equatorial Indian Ocean", (-10.0, 5.0), (55.0, 100.0)),
    ("South Indian Peninsula", (8.0, 17.0), (72.0, 80.5)),
    ("Central India", (17.0, 26.0), (72.0, 86.0)),
    ("Northwest India / Pakistan", (22.0, 32.0), (60.0, 77.0)),
    ("Northeast India / Bangladesh", (22.0, 30.0), (86.0, 97.0)),
    ("Himalaya / Tibetan Plateau", (28.0, 40.0), (75.0, 105.0)),
    ("Afghanistan / Iran", (28.0, 40.0), (55.0, 75.0)),
    ("Myanmar / Indochina", (10.0, 28.0), (95.0, 106.0)),
)
AREA_TAG_DEFAULT = "Surrounding region"

# --- label rules (fixed values) ----------------------------------------------------------------------
GROUP = ("region_id", "lead_day", "season")
PRIMARY_QUANTILE = 0.90
SENSITIVITY_QUANTILE = 0.95
LOW_SPREAD_QUANTILE = 0.25
ACC_QUANTILE = 0.10
SIGNATURE_DOMINANCE = 0.6
SIGNATURE_CLASSES = ("POSITION_PHASE", "AMPLITUDE_STRUCTURE", "RESIDUAL_MIXED")
SIGNATURE_LABELS = {
    "POSITION_PHASE": "Position / phase mismatch",
    "AMPLITUDE_STRUCTURE": "Amplitude / structure mismatch",
    "RESIDUAL_MIXED": "Residual / mixed mismatch",
}
ENSEMBLE_SIZE = 50

# --- analogue memory and support (fixed values) ------------------------------------------------------
ANALOGUE_K = 30
ANALOGUE_MIN = 5
SUPPORT_QUANTILES = (0.90, 0.975, 0.995)
SUPPORT_LEVELS = ("NORMAL SUPPORT", "MODERATE SUPPORT", "WEAK SUPPORT", "INSUFFICIENT HISTORICAL SUPPORT")
EVIDENCE_NAMES = ("STRONG", "MODERATE", "WEAK", "INSUFFICIENT HISTORICAL SUPPORT")
EVIDENCE_WEIGHTS = (1.0, 0.85, 0.7, 0.5)       # by evidence level 0..3
URGENCY_HALFLIFE_DAYS = 5.0
DISAGREEMENT_BONUS = 0.25
RECENT_WINDOW_DAYS = 5
RECENT_MAX_LEAD = 3

# --- quantile family (fixed values) --------------------------------------------------------------------
QUANTILE_LEVELS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
QUANTILE_COLUMNS = ("q10", "q25", "q50", "q75", "q90", "q95")

# --- mixture model of the ensemble (fixed values) ----------------------------------------------------
BMA_WINDOW_DAYS = 60
BMA_MIN_CASES = 20
BMA_MAX_ITER = 200
BMA_TOL = 1e-6

# --- evaluation (fixed values) ---------------------------------------------------------------------------
ALERT_FAR = 0.10
FIXED_FARS = (0.05, 0.10)
RELIABILITY_BINS = 10

# --- feature groups (fixed values) -----------------------------------------------------------------------
FEATURE_GROUPS = {
    "SPREAD": ("spread_m", "spread_pct", "spread_thr_ratio", "lead_day", "region_code", "season_code", "init_hour"),
    "ATM": ("anom500", "abs_anom500", "anom700", "anom850", "thick_anom", "grad_x", "grad_y", "grad_mag",
            "lap500", "nbhd_anom500"),
    "ENS": ("m_iqr", "m_p10p90", "m_skew", "m_sign_agree", "spread_nbhd", "spread_hetero", "spread700",
            "spread850", "spread_growth", "domain_spread", "spread_rel_domain"),
    "PAT": ("pc1", "pc2", "pc3", "pc4", "pc5", "pc6", "pc7", "pc8", "pc_norm", "pc_resid"),
    "EVO": ("rev_region", "rev_nbhd", "rev_pc", "rev_spread", "rev_available"),
    "MEM": ("an_n_within", "an_dist1", "an_dist_mean", "an_bust_rate", "an_err_med", "an_err_q90", "an_n_eligible"),
    "REC": ("rec_err", "rec_bias", "rec_bust_rate", "rec_n", "rec_err_nbhd", "rec_err_domain"),
    "DYN": ("u500_anom", "v500_anom", "ws500", "ws850", "shear_500_850", "vort500", "vort850", "div500", "div850",
            "mslp_anom", "mslp_grad", "wspread500", "wspread850", "mslp_spread", "z500_tend", "mslp_tend",
            "vort500_tend"),
}
# Counts that only grow with time would act as hidden timestamps: evidence yes, model input no.
NON_MODEL_FEATURES = ("an_n_eligible", "an_n_within", "rec_n")
# A column whose name starts with one of these carries verification and may not enter a model or a blind export.
FORBIDDEN_PREFIXES = ("era5_z500", "era5_rank", "error_m", "norm_error", "bust", "sig_", "era5_anom_m", "bias_m",
                      "local_acc", "acc_q10", "pattern_", "magnitude_failure", "hidden_")
GROUP_NAMES = {
    "SPREAD": "Ensemble spread (baseline information)", "ATM": "Atmospheric state", "ENS": "Ensemble behaviour",
    "REC": "Recent verified error behaviour", "PAT": "Large-scale pattern", "EVO": "Forecast evolution",
    "MEM": "Historical forecast-state memory", "DYN": "Wind / vorticity / MSLP state",
}
FEATURE_LABELS = {
    "spread_m": "Z500 ensemble spread (m)",
    "spread_pct": "spread percentile vs training (same region/lead/season)",
    "spread_thr_ratio": "spread relative to the bust threshold (spread / TRAIN Q90 error, m/m)",
    "lead_day": "lead day", "init_hour": "initialisation hour (UTC)", "region_code": "region",
    "season_code": "season",
    "anom500": "ens-mean Z500 anomaly (m)", "abs_anom500": "|Z500 anomaly| (m)", "anom700": "Z700 anomaly (m)",
    "anom850": "Z850 anomaly (m)", "thick_anom": "500-850 hPa thickness anomaly (m)",
    "grad_x": "zonal Z500 gradient (m/100 km)", "grad_y": "meridional Z500 gradient (m/100 km)",
    "grad_mag": "Z500 gradient magnitude (m/100 km)", "lap500": "Z500 curvature (Laplacian, m)",
    "nbhd_anom500": "neighbourhood Z500 anomaly (m)", "m_iqr": "member IQR (m)",
    "m_p10p90": "member P10-P90 range (m)", "m_skew": "member skewness",
    "m_sign_agree": "member anomaly-sign agreement (fraction)", "spread_nbhd": "neighbourhood spread (m)",
    "spread_hetero": "spread heterogeneity (CV)", "spread700": "Z700 spread (m)", "spread850": "Z850 spread (m)",
    "spread_growth": "spread relative to Day 1", "domain_spread": "domain-mean spread (m)",
    "spread_rel_domain": "spread relative to domain mean",
    "pc_norm": "pattern distance from training mean (PC space)", "pc_resid": "unexplained pattern variance fraction",
    "rev_region": "cycle-to-cycle revision, region (m)", "rev_nbhd": "cycle-to-cycle revision, neighbourhood RMS (m)",
    "rev_pc": "cycle-to-cycle pattern revision (PC space)", "rev_spread": "cycle-to-cycle spread change (m)",
    "rev_available": "previous cycle available",
    "an_n_within": "analogues within similarity radius", "an_dist1": "nearest analogue distance",
    "an_dist_mean": "mean analogue distance", "an_bust_rate": "analogue bust rate",
    "an_err_med": "analogue median normalized error", "an_err_q90": "analogue 90th pct normalized error",
    "an_n_eligible": "verified historical cases available",
    "rec_err": "recent verified normalized error, this region (5 d)",
    "rec_bias": "recent verified mean error, this region (m)",
    "rec_bust_rate": "recent verified bust fraction, this region", "rec_n": "recent verified cases (5 d)",
    "rec_err_nbhd": "recent verified normalized error, neighbours",
    "rec_err_domain": "recent verified normalized error, domain",
    "u500_anom": "500 hPa zonal wind anomaly (m/s)", "v500_anom": "500 hPa meridional wind anomaly (m/s)",
    "ws500": "500 hPa wind speed (m/s)", "ws850": "850 hPa wind speed (m/s)",
    "shear_500_850": "500-850 hPa vector wind shear (m/s)", "vort500": "500 hPa relative vorticity (1e-5/s)",
    "vort850": "850 hPa relative vorticity (1e-5/s)", "div500": "500 hPa divergence (1e-5/s)",
    "div850": "850 hPa divergence (1e-5/s)", "mslp_anom": "MSLP anomaly (hPa)",
    "mslp_grad": "MSLP gradient (hPa/100 km)", "wspread500": "500 hPa vector-wind spread (m/s)",
    "wspread850": "850 hPa vector-wind spread (m/s)", "mslp_spread": "MSLP ensemble spread (hPa)",
    "z500_tend": "Z500 change per day in this forecast (m/day)",
    "mslp_tend": "MSLP change per day in this forecast (hPa/day)",
    "vort500_tend": "500 hPa vorticity change per day in this forecast (1e-5/s/day)",
}

# --- plausible ranges of the extra variables (fixed values; m/s and Pa) -------------------------------------
EXTRA_RANGES = {"u_mean": (-120.0, 120.0), "v_mean": (-120.0, 120.0), "mslp_mean": (85000.0, 110000.0),
                "u_std": (0.0, 60.0), "v_std": (0.0, 60.0), "mslp_std": (0.0, 6000.0)}
