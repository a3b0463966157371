"""Thresholds, labels and lookup lists that results must agree on.

Everything here is data. A ladder lists (bound, label) steps in the order they are
tried; ``op`` says how a value is compared with the bound, ``otherwise`` is the label
when no step matches (NULL values never match a step) and ``null`` overrides that
label for NULL values.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ladder:
    op: str
    steps: tuple[tuple[float, str], ...]
    otherwise: str
    null: str | None = None

    @property
    def labels(self) -> list[str]:
        return [label for _, label in self.steps] + [self.otherwise]


# --- fixed values: enumerations -------------------------------------------------------
ORDER_STATUSES = [
    "delivered", "shipped", "canceled", "unavailable",
    "invoiced", "processing", "created", "approved",
]
PAYMENT_TYPES = ["credit_card", "boleto", "voucher", "debit_card", "not_defined"]
PAYMENT_TYPE_DISPLAY = {
    "credit_card": "Credit Card",
    "boleto": "Boleto",
    "voucher": "Voucher",
    "debit_card": "Debit Card",
}
PAYMENT_TYPE_OTHER = "Other"
DELIVERY_PERFORMANCES = ["early", "on_time", "late"]
REVIEW_SENTIMENTS = ["positive", "neutral", "negative"]
REVIEW_SCORES = [1, 2, 3, 4, 5]
REVIEW_SCORE_CATEGORIES = {5: "Excellent", 4: "Good", 3: "Average", 2: "Poor", 1: "Very Poor"}
REVIEW_SCORE_UNKNOWN = "Unknown"
LOCATION_TYPES = ["Both", "Customer Only", "Seller Only", "Unknown"]
RFM_SEGMENTS = [
    "Champions", "Loyal Customers", "New Customers", "At Risk", "Lost", "Big Spenders", "Regular",
]
LIFECYCLE_STAGES = [
    "Active Repeat", "Active New", "Cooling Down", "At Risk", "Dormant", "Never Purchased",
]
VALUE_TIER_ORDER = ["VIP", "High Value", "Medium Value", "Low Value", "No Orders"]
SELLER_HEALTH_ORDER = ["Excellent", "Good", "Average", "Needs Improvement", "New/Unknown"]
SELLER_ACTIVITY_ORDER = ["Active (30d)", "Recent (90d)", "Cooling (180d)", "Inactive", "No Sales"]
SELLER_TIER_ORDER = [
    "Top Performer", "High Performer", "Medium Performer", "Low Performer", "No Sales",
]
# (revenue at least, average review at least, tier); any other revenue above zero is the fourth tier
SELLER_PERFORMANCE_STEPS = [
    (50000, 4.5, "Top Performer"),
    (20000, 4.0, "High Performer"),
    (5000, 3.5, "Medium Performer"),
]
GEOGRAPHIC_FOCUS = ["Local Focused", "Regional", "National", "Multi-Regional"]
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"

# --- fixed values: Brazilian geography ------------------------------------------------
STATE_NAMES = {
    "AC": "Acre", "AL": "Alagoas", "AM": "Amazonas", "AP": "Amapá", "BA": "Bahia",
    "CE": "Ceará", "DF": "Distrito Federal", "ES": "Espírito Santo", "GO": "Goiás",
    "MA": "Maranhão", "MG": "Minas Gerais", "MS": "Mato Grosso do Sul", "MT": "Mato Grosso",
    "PA": "Pará", "PB": "Paraíba", "PE": "Pernambuco", "PI": "Piauí", "PR": "Paraná",
    "RJ": "Rio de Janeiro", "RN": "Rio Grande do Norte", "RO": "Rondônia", "RR": "Roraima",
    "RS": "Rio Grande do Sul", "SC": "Santa Catarina", "SE": "Sergipe", "SP": "São Paulo",
    "TO": "Tocantins",
}
REGION_STATES = {
    "North": ["AC", "AM", "AP", "PA", "RO", "RR", "TO"],
    "Northeast": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "Central-West": ["DF", "GO", "MT", "MS"],
    "Southeast": ["ES", "MG", "RJ", "SP"],
    "South": ["PR", "RS", "SC"],
}
REGION_UNKNOWN = "Unknown"

# --- fixed values: national holidays as (month, day, name) ----------------------------
HOLIDAYS = [
    (1, 1, "New Year's Day"),
    (4, 21, "Tiradentes' Day"),
    (5, 1, "Labor Day"),
    (9, 7, "Independence Day"),
    (10, 12, "Our Lady of Aparecida"),
    (11, 2, "All Souls' Day"),
    (11, 15, "Proclamation of the Republic"),
    (11, 20, "Black Consciousness Day"),
    (12, 25, "Christmas Day"),
]

# --- fixed values: category groups ----------------------------------------------------
CATEGORY_GROUPS = {
    "Home & Furniture": [
        "bed_bath_table", "furniture_decor", "housewares", "home_construction",
        "furniture_bedroom", "furniture_living_room", "home_comfort_2", "garden_tools",
        "home_confort", "flowers", "furniture_mattress_and_upholstery",
    ],
    "Health & Beauty": ["health_beauty", "perfumery", "diapers_and_hygiene"],
    "Sports & Leisure": ["sports_leisure", "toys", "baby", "fashion_sport"],
    "Electronics & Computers": [
        "computers_accessories", "telephony", "electronics", "computers",
        "tablets_printing_image", "fixed_telephony", "consoles_games", "pc_gamer",
        "signaling_and_security", "security_and_services",
    ],
    "Fashion & Accessories": [
        "watches_gifts", "fashion_bags_accessories", "fashion_shoes", "fashion_male_clothing",
        "fashion_underwear_beach", "fashion_childrens_clothes", "fashio_female_clothing",
    ],
    "Automotive": ["auto", "automotive"],
    "Books & Media": [
        "books_general_interest", "books_technical", "books_imported", "audio", "music",
        "cds_dvds_musicals", "dvds_blu_ray",
    ],
    "Arts & Gifts": [
        "cool_stuff", "art", "arts_and_craftmanship", "christmas_supplies", "party_supplies",
        "cine_photo",
    ],
    "Food & Pets": ["pet_shop", "food", "food_drink", "drinks"],
    "Office & Tools": [
        "office_furniture", "stationery", "industry_commerce_and_business",
        "construction_tools_safety", "construction_tools_construction",
        "construction_tools_tools", "construction_tools_lights", "la_cuisine",
        "small_appliances", "small_appliances_home_oven_and_coffee", "air_conditioning",
        "kitchen_dining_laundry_garden_furniture",
    ],
}
CATEGORY_GROUP_OTHER = "Other"

# --- fixed values: tiers of the star schema -------------------------------------------
PRICE_TIER = Ladder(">=", ((200, "Premium"), (100, "High"), (50, "Medium"), (20, "Low")), "Budget")
CATEGORY_PRICE_TIER = Ladder(PRICE_TIER.op, PRICE_TIER.steps, PRICE_TIER.otherwise, null="Unknown")
VOLUME_TIER = Ladder(
    ">=",
    ((100000, "Extra Large"), (50000, "Large"), (10000, "Medium"), (1000, "Small")),
    "Extra Small",
    null="Unknown",
)
WEIGHT_TIER = Ladder(
    "<", ((500, "Light"), (2000, "Medium"), (5000, "Heavy")), "Extra Heavy", null="Unknown"
)
QUALITY_TIER = Ladder(">=", ((4, "Excellent"), (3, "Good"), (2, "Fair")), "Poor")
PRODUCT_SALES_TIER = Ladder(
    ">=",
    ((100, "Top Seller"), (50, "High Seller"), (10, "Medium Seller"), (1, "Low Seller")),
    "No Sales",
)
MART_SALES_TIER = Ladder(
    ">=",
    ((100, "Best Seller"), (50, "Top Seller"), (10, "Good Seller"), (1, "Low Seller")),
    "No Sales",
)
MART_REVIEW_TIER = Ladder(
    ">=",
    ((4.5, "Excellent"), (4.0, "Very Good"), (3.5, "Good"), (3.0, "Average")),
    "Below Average",
    null="No Reviews",
)
SELLER_SIZE_TIER = Ladder(
    ">=",
    ((500, "Large Seller"), (100, "Medium Seller"), (10, "Small Seller"), (1, "Micro Seller")),
    "No Sales",
)
CATEGORY_REVENUE_TIER = Ladder(
    ">=",
    (
        (100000, "Top Category"), (50000, "High Revenue"), (10000, "Medium Revenue"),
        (1000, "Low Revenue"), (0.01, "Minimal Revenue"),
    ),
    "No Sales",
)
CATEGORY_SIZE_TIER = Ladder(
    ">=",
    (
        (1000, "Large Category"), (500, "Medium Category"), (100, "Small Category"),
        (1, "Niche Category"),
    ),
    "No Sales",
)
FREIGHT_TIER = Ladder(
    ">=", ((30, "High Shipping"), (15, "Medium Shipping")), "Low Shipping", null="Unknown"
)
CITY_SIZE_TIER = Ladder(
    ">=",
    ((1000, "Major City"), (100, "Large City"), (10, "Medium City"), (1, "Small City")),
    "Rural",
)
CUSTOMER_SEGMENT = Ladder(
    ">=", ((3, "Repeat Customer"), (2, "Second Time"), (1, "One Time")), "No Orders"
)
PAYMENT_VALUE_TIER = Ladder(
    ">=", ((500, "Very High"), (200, "High"), (100, "Medium"), (50, "Low")), "Very Low"
)
INSTALLMENT_CATEGORY = Ladder(
    ">=",
    (
        (13, "Extended Term (12+)"), (7, "Long Term (7-12)"), (4, "Medium Term (4-6)"),
        (2, "Short Term (2-3)"), (1, "Full Payment"),
    ),
    "Unknown",
)
REVIEW_TIMING = Ladder(
    "<=",
    ((1, "Immediate"), (7, "Within Week"), (30, "Within Month")),
    "After Month",
    null="Unknown",
)
ANSWER_TIMING = Ladder(
    "<=",
    ((1, "Same/Next Day"), (7, "Within Week"), (30, "Within Month")),
    "After Month",
)
ANSWER_MISSING = "No Answer"
COMMENT_DETAIL = Ladder(
    ">", ((200, "Detailed"), (50, "Moderate")), "Brief", null="No Comment"
)
CUSTOMER_VALUE_TIER = Ladder(
    ">=",
    ((1000, "VIP"), (500, "High Value"), (200, "Medium Value"), (0.01, "Low Value")),
    "No Orders",
)
DIVERSITY_TYPE = Ladder(
    "<=", ((1, "Specialist"), (3, "Focused"), (5, "Diverse")), "Generalist"
)

# --- fixed values: buckets of the analyses --------------------------------------------
ORDER_VALUE_5 = Ladder(
    "<",
    ((50, "< R$ 50"), (100, "R$ 50-100"), (200, "R$ 100-200"), (500, "R$ 200-500")),
    "R$ 500+",
)
ORDER_VALUE_7 = Ladder(
    "<",
    (
        (50, "< R$ 50"), (100, "R$ 50-100"), (150, "R$ 100-150"), (200, "R$ 150-200"),
        (300, "R$ 200-300"), (500, "R$ 300-500"),
    ),
    "R$ 500+",
)
ORDER_VALUE_4 = Ladder(
    "<", ((100, "< R$ 100"), (200, "R$ 100-200"), (500, "R$ 200-500")), "R$ 500+"
)
FREIGHT_RANGE = Ladder(
    "<",
    ((10, "< R$ 10"), (20, "R$ 10-20"), (30, "R$ 20-30"), (50, "R$ 30-50")),
    "R$ 50+",
)
FREIGHT_SEGMENT = Ladder("<", ((15, "Low Freight"), (25, "Medium Freight")), "High Freight")
DELIVERY_DAYS = Ladder(
    "<",
    ((7, "< 7 days"), (14, "7-14 days"), (21, "14-21 days"), (30, "21-30 days")),
    "30+ days",
)
DELIVERY_SPEED = Ladder(
    "<",
    ((7, "< 7 days (Fast)"), (14, "7-14 days"), (21, "14-21 days"), (30, "21-30 days")),
    "30+ days (Slow)",
)
ORDER_COUNT_LTV = Ladder(
    "<=", ((1, "1 Order"), (2, "2 Orders"), (3, "3 Orders"), (5, "4-5 Orders")), "6+ Orders"
)
ORDER_COUNT_RETENTION = Ladder(
    "<=",
    ((1, "1 Order (One-time)"), (2, "2 Orders"), (3, "3 Orders"), (5, "4-5 Orders")),
    "6+ Orders",
)
REACTIVATION = Ladder(
    "<=",
    (
        (30, "Active (0-30 days)"), (90, "At Risk (31-90 days)"), (180, "Dormant (91-180 days)"),
        (365, "Lapsed (181-365 days)"),
    ),
    "Churned (365+ days)",
)
DORMANCY = Ladder("<=", ((180, "Dormant"), (365, "Lapsed")), "Churned")
DORMANT_VALUE = Ladder("<", ((200, "Low Value"), (500, "Medium Value")), "High Value")
# installment count to range; zero installments belong to the last range
INSTALLMENT_RANGES = [
    (1, 1, "1x (No installment)"), (2, 3, "2-3x"), (4, 6, "4-6x"), (7, 10, "7-10x"),
]
INSTALLMENT_RANGE_OTHER = "10+x"
INSTALLMENT_GROUP_STEPS = [(1, 1, "1x"), (None, 3, "2-3x"), (None, 6, "4-6x"), (None, 10, "7-10x")]
# right-closed bins in days: (above, up to, label); zero days falls in none
SECOND_PURCHASE_BINS = [
    (0, 30, "0-30 days"), (30, 60, "31-60 days"), (60, 90, "61-90 days"),
    (90, 120, "91-120 days"), (120, 180, "121-180 days"), (180, 365, "181-365 days"),
    (365, None, "365+ days"),
]
MODEL_LAYERS = [
    ("stg_", "staging"), ("int_", "intermediate"), ("dim_", "dimension"), ("fct_", "fact"),
    ("mart_", "mart"),
]
MODEL_LAYER_OTHER = "other"
