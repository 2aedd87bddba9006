"""Fixed values of the risk model. Results depend on every one of them."""

from __future__ import annotations

# fixed values: calibrated bands (score at least) and display bands
RISK_BANDS = [(0.29, "critical"), (0.2634, "action"), (0.18, "elevated"), (0.10, "watch")]
DISPLAY_BANDS = [(0.85, "CRITICAL"), (0.70, "ACTION"), (0.45, "ELEVATED"), (0.25, "WATCH")]
BAND_ORDER = ["calm", "watch", "elevated", "action", "critical"]

# fixed values: batching, decay and propagation
FLUSH_SIZE = 10
HALF_LIFE_H = 48.0
CASCADE_DECAY, CASCADE_HOPS, CASCADE_FLOOR = 0.6, 2, 0.15
FIRE_COOLDOWN_S, SYNTHESIS_COOLDOWN_S, PENDING_TTL_H = 600, 1800, 72
INGEST_IMMEDIATE = 0.80
RETENTION_DAYS = 5

# fixed values: price changepoints
HAZARD, CP_PROBABILITY, CP_Z, REGIME_VOL = 0.01, 0.6, 3.5, 3.0

# fixed values: triage
TRIAGE_SYNTHESIZE, TRIAGE_EXTRACT = 0.72, 0.40

# fixed values: the supply cascade
BARRELS_PER_TONNE, GLOBAL_SUPPLY, STRAIT_FLOW = 7.33, 100.0, 20.0
SCENARIO = {
    "consumption": 5.15, "import_pct": 88.2, "share_pct": 42.5, "spr_total": 5.33, "spr_fill": 0.40, "spr_draw": 2.5, "spr_floor_days": 0.0,
    "bypass": 4.0, "ramp_days": 5.0, "inventory_days": 22.0, "price_low": 3.5, "price_high": 6.0, "spare": 3.5, "global_bypass": 4.0,
    "gdp_per_usd": -0.04, "cpi_per_usd": 0.035, "fraction": 1.0, "days": 30, "horizon": 45, "profile": "constant", "bypass_blocked": 0.0, "policy": "moderate",
    "demand_cut": 0.0, "supply_cut": 0.0,
}
POLICY_DRAW = {"aggressive": 1.5, "moderate": 1.0, "none": 0.0}

# fixed values: procurement
GRADE_API_SIGMA, GRADE_API_FLOOR, GRADE_S_SIGMA, GRADE_S_FLOOR, GRADE_API_W, GRADE_S_W = 8.0, 0.5, 0.25, 0.30, 0.6, 0.4
TOPSIS_WEIGHTS = {"cost": 0.35, "lead": 0.25, "compat": 0.25, "risk": 0.15}
BRENT, WAR_PER_UNIT, RISK_MAX = 95.0, 0.80, 0.5
BERTH_WAIT_DAYS, DEMURRAGE_PER_DAY, CARGO_BBL, TANKER_PENALTY_DAYS = 3.0, 35_000.0, 2_000_000.0, 5.0

# fixed values: the reserve planner
SDP_LEVELS, SDP_DISCOUNT = 30, 0.97
SDP_ACTIONS = [0.0, 0.1, 0.25, 0.5, 1.0]
BBL_TO_MMT = 1.09e-7

# fixed values: projections
HORIZONS_H = [6, 12, 18, 24, 36, 48, 72]
REVERSION, Z90 = 0.80, 1.2816

# fixed values: severity and tone of the sentiment labels
SENTIMENT_SEVERITY = {"Highly Risky": 0.95, "Risky": 0.75, "Satisfactory": 0.40, "Safe": 0.15, "Completely Safe": 0.05}
SENTIMENT_TONE = {"Highly Risky": -8.0, "Risky": -4.0, "Satisfactory": 0.0, "Safe": 4.0, "Completely Safe": 8.0}
