"""Thresholds and label vocabularies of the inventory-policy rules.

Every rule threshold lives in :class:`Thresholds` so a user can re-tune
the policy without touching operator code; the defaults are the
values the published analysis uses.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # stock cover (days of forecast demand held in inventory)
    low_cover_days: float = 1.0
    high_cover_days: float = 7.0
    # share of days with low / high cover, as a fraction (policy view)
    low_cover_rate: float = 0.20
    high_cover_rate: float = 0.20
    zero_inventory_rate: float = 0.05
    # forecast quality
    wape_poor: float = 0.35
    wape_good: float = 0.20
    bias_abs: float = 0.10
    # replenishment
    ratio_low: float = 0.85
    ratio_high: float = 1.15
    order_day_rate_low: float = 0.10
    order_day_rate_high: float = 0.80
    # cadence (the assessment works on percentages and day gaps)
    continuous_order_day_pct: float = 95.0
    continuous_gap_days: float = 1.5
    irregular_gap_stddev: float = 5.0
    sparse_gap_days: float = 14.0
    # demand variability (coefficient of variation)
    cv_medium: float = 0.50
    cv_high: float = 1.00
    # ABC cut-offs on the cumulative sales share
    abc_a: float = 0.80
    abc_b: float = 0.95

    @property
    def low_cover_pct(self) -> float:
        return 100.0 * self.low_cover_rate

    @property
    def high_cover_pct(self) -> float:
        return 100.0 * self.high_cover_rate

    @property
    def zero_inventory_pct(self) -> float:
        return 100.0 * self.zero_inventory_rate


DEFAULT = Thresholds()

# Velocity and forecast quality have three labels each, hence three tiles.
TILES = 3

# ---------------------------------------------------------------------------
# Label strings that must equal the published analysis
# exactly (dashboards and downstream filters match on them).
# ---------------------------------------------------------------------------
ABC_A, ABC_B, ABC_C = "A", "B", "C"
VELOCITY_FAST, VELOCITY_MEDIUM, VELOCITY_SLOW = "Fast", "Medium", "Slow"
FORECAST_GOOD, FORECAST_MODERATE, FORECAST_POOR = "Good", "Moderate", "Poor"
POSITION_UNDER, POSITION_OVER, POSITION_BALANCED = "Understocked", "Overstocked", "Balanced"

STATUS_MIXED = "Mixed Instability"
STATUS_UNDER = "Understock Risk"
STATUS_OVER = "Overstock Risk"
STATUS_STABLE = "Stable"

CAUSE_BOTH = "Forecast + Replenishment"
CAUSE_FORECAST = "Forecast-driven"
CAUSE_REPLENISHMENT = "Replenishment-driven"
CAUSE_MONITOR = "Monitor"

PRIORITY_HIGH, PRIORITY_MEDIUM, PRIORITY_LOW = "High", "Medium", "Low"

TRIGGER_LATE = "Trigger Too Late / Reactive"
TRIGGER_EARLY = "Trigger Too Early / Excessive"
TRIGGER_OK = "Trigger Broadly Reasonable"

BUFFER_INSUFFICIENT = "Buffer Insufficient"
BUFFER_EXCESSIVE = "Buffer Excessive"
BUFFER_REVIEW = "Buffer Needs Review"
BUFFER_OK = "Buffer Broadly Adequate"

CADENCE_CONTINUOUS = "Continuous Daily Ordering"
CADENCE_IRREGULAR = "Irregular Cadence"
CADENCE_SPARSE = "Sparse / Long-Gap Ordering"
CADENCE_MODERATE = "Moderate Cadence"

VARIABILITY_HIGH = "High Variability"
VARIABILITY_MEDIUM = "Medium Variability"
VARIABILITY_LOW = "Low Variability"

THEME_EXCESS = "Excess / Working Capital"
THEME_SERVICE = "Service Risk"
THEME_BURDEN = "Operational Burden"
THEME_MONITOR = "Monitor"
