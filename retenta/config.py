"""Settings that decide results."""

from __future__ import annotations

# They must stay as they are for results to agree.
CHURN_CUTOFF_DATE = "2017-06-01"
CHURN_WINDOW_DAYS = 365
INACTIVITY_DAYS = 180
ALIVE_THRESHOLD = 0.5
RANDOM_SEED = 42
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
PENALIZER = 0.01
CLV_MONTHS = 12
CLV_DISCOUNT_RATE = 0.01
WEEKS_PER_MONTH = 4.345
DELIVERED = "delivered"
RISK_TIERS = ["Low", "Medium", "High"]
FEATURE_COLS = [
    "monetary_value",
    "avg_order_value",
    "avg_review_score",
    "avg_delivery_days",
    "n_distinct_categories",
    "avg_freight_value",
    "used_installments",
]
# End of fixed values.
