"""Number-backed evidence sentences: templates filled with computed values, never free text.

Every sentence is a ``format_string`` over columns; a missing input drops the item or selects its fallback text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sentence templates (fixed formats of the evidence contract)
EVIDENCE_KINDS = {
    "spread": "A. Ensemble evidence",
    "state": "B. Atmospheric-state evidence",
    "history": "C. Historical evidence",
    "recent": "C2. Recent verified error behaviour",
    "evolution": "D. Forecast-evolution evidence",
    "baseline": "E. Baseline comparison",
    "distribution": "E. Predicted error distribution",
}
EVIDENCE_TEMPLATES = {
    "spread": "Z500 ensemble spread %.1f m = %.0fth percentile of training spread for this region, lead day and season; "
              "member anomaly-sign agreement %.0f%%.",
    "state": "Forecast Z500 anomaly %+.0f m (|anomaly| at the %.0fth training percentile); pattern distance from the training "
             "mean %.2f (PC units).",
    "history": "Of the 30 most similar verified historical forecast states for this region and lead day (%d verified cases "
               "available; %d within the similarity radius), %.0f%% exceeded the bust threshold (climatological rate %.0f%%).",
    "history_missing": "Historical support unavailable for this forecast state (too few verified analogues).",
    "recent": "Over the 5 days before initialisation, verified Day 1-3 forecasts for this region had mean normalized error %.2f "
              "(mean error %+.1f m; %.0f%% busts, n = %d); neighbouring regions %.2f, whole domain %.2f.",
    "evolution": "Versus the cycle 24 h earlier (same valid time) the regional Z500 forecast moved %.1f m (neighbourhood RMS "
                 "revision %.1f m, %.0fth training percentile).",
    "evolution_missing": "Previous-cycle forecast for the same valid time not available in the downloaded archive.",
    "baseline": "B2 bust probability %.1f%% vs climatological rate B0 %.1f%% for this region, lead day and season (%+.1f "
                "percentage points).",
    "distribution": "Central predicted error (q50) %.2fx normal; central predicted range (q25-q75) %.2f-%.2fx; upper-tail error "
                    "(q95) %.2fx; project bust threshold %.2fx. Estimated exceedance probability %.0f%% -> calibrated bust "
                    "probability %.0f%%.",
}


def _num(x) -> Column:
    """Numbers enter templates with decimal ties pushed up, so every engine prints the same digits."""
    c = F.col(x) if isinstance(x, str) else x
    return c + F.lit(1e-9)


def _pct(x) -> Column:
    return _num(100 * (F.col(x) if isinstance(x, str) else x))


def sentence(name: str, *args: Column) -> Column:
    return F.format_string(EVIDENCE_TEMPLATES[name], *args)


def item(kind: str, text: Column, when: Column | None = None) -> Column:
    s = F.struct(F.lit(EVIDENCE_KINDS[kind]).alias("kind"), text.alias("text"))
    return s if when is None else F.when(when, s)


def spread_evidence() -> Column:
    return item("spread", sentence("spread", _num("spread_m"), _pct("spread_pct"), _pct("m_sign_agree")), F.col("spread_pct").isNotNull())


def state_evidence() -> Column:
    return item("state", sentence("state", _num("anom500"), _pct("abs_anom_pct"), _num("pc_norm")), F.col("anom500").isNotNull())


def history_evidence() -> Column:
    text = sentence("history", F.col("an_n_eligible").cast("long"), F.col("an_n_within").cast("long"), _pct("an_bust_rate"), _pct("base_rate"))
    return item("history", F.when(F.col("an_bust_rate").isNotNull(), text).otherwise(EVIDENCE_TEMPLATES["history_missing"]))


def evolution_evidence() -> Column:
    text = sentence("evolution", _num("rev_region"), _num("rev_nbhd"), _pct("rev_nbhd_pct"))
    return item("evolution", F.when(F.col("rev_region").isNotNull(), text).otherwise(EVIDENCE_TEMPLATES["evolution_missing"]))


def recent_evidence() -> Column:
    text = sentence("recent", _num("rec_err"), _num("rec_bias"), _pct("rec_bust_rate"), F.col("rec_n").cast("long"), _num("rec_err_nbhd"), _num("rec_err_domain"))
    return item("recent", text, F.col("rec_err").isNotNull())


def baseline_evidence(p: str, p_clim: str) -> Column:
    return item("baseline", sentence("baseline", _pct(p), _pct(p_clim), _pct(F.col(p) - F.col(p_clim))))


def distribution_evidence(p_raw: str, p_cal: str, threshold: str) -> Column:
    return item("distribution", sentence("distribution", _num("q50"), _num("q25"), _num("q75"), _num("q95"), _num(threshold), _pct(p_raw), _pct(p_cal)))


def evidence_list(*items: Column) -> Column:
    """Present items in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def alert_statement(p: str, threshold: Column) -> Column:
    """Position of a probability against the alert threshold."""
    side = F.when(F.col(p) >= threshold, "At or above").otherwise("Below")
    return F.concat(side, F.format_string(" the alert threshold %.1f%% (10%% false-alarm rate on validation).", _pct(threshold)))


def tail_statement(q95: str, threshold: str) -> Column:
    """Position of the predicted upper tail against the threshold."""
    verb = F.when(F.col(q95) > F.col(threshold), "is above").otherwise("stays below")
    return F.concat(F.format_string("The predicted upper-tail error (%.2fx) ", _num(q95)), verb,
                    F.format_string(" the project bust threshold (%.2fx).", _num(threshold)))
