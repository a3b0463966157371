"""Every ladder of the fixed values against the values written out here, at and beside each bound."""

import pytest
from pyspark.sql import functions as F

from bazarlytics.functions import values
from bazarlytics.functions.columns import tier

# fixed values: how a value compares with a bound, the (bound, label) steps in order, the label
# of all other values, and the label of null
LADDERS = {
    "ANSWER_TIMING": ("<=", [(1, "Same/Next Day"), (7, "Within Week"), (30, "Within Month")], "After Month", None),
    "CATEGORY_PRICE_TIER": (
        ">=",
        [(200, "Premium"), (100, "High"), (50, "Medium"), (20, "Low")],
        "Budget",
        "Unknown",
    ),
    "CATEGORY_REVENUE_TIER": (
        ">=",
        [(100000, "Top Category"), (50000, "High Revenue"), (10000, "Medium Revenue"), (1000, "Low Revenue"), (0.01, "Minimal Revenue")],
        "No Sales",
        None,
    ),
    "CATEGORY_SIZE_TIER": (
        ">=",
        [(1000, "Large Category"), (500, "Medium Category"), (100, "Small Category"), (1, "Niche Category")],
        "No Sales",
        None,
    ),
    "CITY_SIZE_TIER": (
        ">=",
        [(1000, "Major City"), (100, "Large City"), (10, "Medium City"), (1, "Small City")],
        "Rural",
        None,
    ),
    "COMMENT_DETAIL": (">", [(200, "Detailed"), (50, "Moderate")], "Brief", "No Comment"),
    "CUSTOMER_SEGMENT": (">=", [(3, "Repeat Customer"), (2, "Second Time"), (1, "One Time")], "No Orders", None),
    "CUSTOMER_VALUE_TIER": (
        ">=",
        [(1000, "VIP"), (500, "High Value"), (200, "Medium Value"), (0.01, "Low Value")],
        "No Orders",
        None,
    ),
    "DELIVERY_DAYS": (
        "<",
        [(7, "< 7 days"), (14, "7-14 days"), (21, "14-21 days"), (30, "21-30 days")],
        "30+ days",
        None,
    ),
    "DELIVERY_SPEED": (
        "<",
        [(7, "< 7 days (Fast)"), (14, "7-14 days"), (21, "14-21 days"), (30, "21-30 days")],
        "30+ days (Slow)",
        None,
    ),
    "DIVERSITY_TYPE": ("<=", [(1, "Specialist"), (3, "Focused"), (5, "Diverse")], "Generalist", None),
    "DORMANCY": ("<=", [(180, "Dormant"), (365, "Lapsed")], "Churned", None),
    "DORMANT_VALUE": ("<", [(200, "Low Value"), (500, "Medium Value")], "High Value", None),
    "FREIGHT_RANGE": ("<", [(10, "< R$ 10"), (20, "R$ 10-20"), (30, "R$ 20-30"), (50, "R$ 30-50")], "R$ 50+", None),
    "FREIGHT_SEGMENT": ("<", [(15, "Low Freight"), (25, "Medium Freight")], "High Freight", None),
    "FREIGHT_TIER": (">=", [(30, "High Shipping"), (15, "Medium Shipping")], "Low Shipping", "Unknown"),
    "INSTALLMENT_CATEGORY": (
        ">=",
        [(13, "Extended Term (12+)"), (7, "Long Term (7-12)"), (4, "Medium Term (4-6)"), (2, "Short Term (2-3)"), (1, "Full Payment")],
        "Unknown",
        None,
    ),
    "MART_REVIEW_TIER": (
        ">=",
        [(4.5, "Excellent"), (4.0, "Very Good"), (3.5, "Good"), (3.0, "Average")],
        "Below Average",
        "No Reviews",
    ),
    "MART_SALES_TIER": (
        ">=",
        [(100, "Best Seller"), (50, "Top Seller"), (10, "Good Seller"), (1, "Low Seller")],
        "No Sales",
        None,
    ),
    "ORDER_COUNT_LTV": (
        "<=",
        [(1, "1 Order"), (2, "2 Orders"), (3, "3 Orders"), (5, "4-5 Orders")],
        "6+ Orders",
        None,
    ),
    "ORDER_COUNT_RETENTION": (
        "<=",
        [(1, "1 Order (One-time)"), (2, "2 Orders"), (3, "3 Orders"), (5, "4-5 Orders")],
        "6+ Orders",
        None,
    ),
    "ORDER_VALUE_4": ("<", [(100, "< R$ 100"), (200, "R$ 100-200"), (500, "R$ 200-500")], "R$ 500+", None),
    "ORDER_VALUE_5": (
        "<",
        [(50, "< R$ 50"), (100, "R$ 50-100"), (200, "R$ 100-200"), (500, "R$ 200-500")],
        "R$ 500+",
        None,
    ),
    "ORDER_VALUE_7": (
        "<",
        [(50, "< R$ 50"), (100, "R$ 50-100"), (150, "R$ 100-150"), (200, "R$ 150-200"), (300, "R$ 200-300"), (500, "R$ 300-500")],
        "R$ 500+",
        None,
    ),
    "PAYMENT_VALUE_TIER": (">=", [(500, "Very High"), (200, "High"), (100, "Medium"), (50, "Low")], "Very Low", None),
    "PRICE_TIER": (">=", [(200, "Premium"), (100, "High"), (50, "Medium"), (20, "Low")], "Budget", None),
    "PRODUCT_SALES_TIER": (
        ">=",
        [(100, "Top Seller"), (50, "High Seller"), (10, "Medium Seller"), (1, "Low Seller")],
        "No Sales",
        None,
    ),
    "QUALITY_TIER": (">=", [(4, "Excellent"), (3, "Good"), (2, "Fair")], "Poor", None),
    "REACTIVATION": (
        "<=",
        [(30, "Active (0-30 days)"), (90, "At Risk (31-90 days)"), (180, "Dormant (91-180 days)"), (365, "Lapsed (181-365 days)")],
        "Churned (365+ days)",
        None,
    ),
    "REVIEW_TIMING": ("<=", [(1, "Immediate"), (7, "Within Week"), (30, "Within Month")], "After Month", "Unknown"),
    "SELLER_SIZE_TIER": (
        ">=",
        [(500, "Large Seller"), (100, "Medium Seller"), (10, "Small Seller"), (1, "Micro Seller")],
        "No Sales",
        None,
    ),
    "VOLUME_TIER": (
        ">=",
        [(100000, "Extra Large"), (50000, "Large"), (10000, "Medium"), (1000, "Small")],
        "Extra Small",
        "Unknown",
    ),
    "WEIGHT_TIER": ("<", [(500, "Light"), (2000, "Medium"), (5000, "Heavy")], "Extra Heavy", "Unknown"),
}
MEETS = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__, "=": float.__eq__}


def expected(value, op, steps, otherwise, null):
    if value is None:
        return otherwise if null is None else null
    return next((label for bound, label in steps if MEETS[op](value, float(bound))), otherwise)


def test_every_ladder_is_written_out():
    assert {n for n in dir(values) if isinstance(getattr(values, n), values.Ladder)} == set(LADDERS)


@pytest.mark.parametrize("name", LADDERS)
def test_labels_at_the_bounds(spark, name):
    points = {None} | {float(b) + d for b, _ in LADDERS[name][1] for d in (-1.0, -0.01, 0.0, 0.01, 1.0)}
    df = spark.createDataFrame([(p,) for p in points], "x double")
    got = {r.x: r.label for r in df.select("x", tier(F.col("x"), getattr(values, name)).alias("label")).collect()}
    assert got == {p: expected(p, *LADDERS[name]) for p in points}
