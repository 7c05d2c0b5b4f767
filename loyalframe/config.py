"""Vocabularies and behaviour flags.

Every string here is a fixed value: it has to equal the text found in the
shop export or the text the datasets publish, so it is listed as-is.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values (data and output vocabulary) -----------------------------
CANCELLED_STATUS = "Đã hủy"
GIFT_CATEGORY = "Quà tặng"
NO_USERNAME = "No Username"

# (brand text in the label table, column-name suffix), in output order
BRANDS = (
    ("Kinka", "Kinka"),
    ("Revy", "Revy"),
    ("SiMee", "SiMee"),
    ("Y tế", "Medical"),
    ("IONCare", "IONCare"),
)
# brands followed through the entry funnel, in tie-break priority order
FUNNEL_BRANDS = ("Kinka", "Revy", "SiMee")

TIER_AFFILIATOR = "Affiliator"
TIER_CANCELED = "Canceled/No Purchases"
TIER_CONFUSED = "Confused One-Time Buyer"
TIER_LOYAL = "Regular / Loyal"
TIER_ONE_TIME = "One-Time Buyer"
UNSORTED = "Unsorted"

GROUP_NONE = "Not buy any of 3 brands"
GROUP_ALL_THREE = "Start with all 3 brands"
ONLY_WITH = "Only with {}"
START_WITH = "Start with {}"
START_WITH_PAIR = "Start with {} and {}"

STATUS_SWITCHER = "Switcher"
STATUS_NON_SWITCHER = "Non-switcher"

ACQ_NEW = "Newly Accquired"
ACQ_RETURNING = "Return From Previous Month"
WHOLE_PERIOD = "Toàn kỳ"

# order of the funnel groups in the monthly stack chart
STACK_ORDER = (
    "Only with Kinka", "Start with Kinka", "Start with Kinka and Revy", "Start with Kinka and SiMee",
    "Only with Revy", "Start with Revy", "Start with Revy and SiMee",
    "Only with SiMee", "Start with SiMee", "Start with all 3 brands",
)

# a buyer whose first and last order are closer than this many days, with a
# cancellation among >= 2 orders, is a "Confused One-Time Buyer"
CONFUSED_MAX_DAYS = 0.0208

# phase boundaries (last month of each phase); later months are the last phase
PHASES = (("P1", "2025-12"), ("P2", "2026-03"), ("P3", None))

# time text formats
EXPORT_TIME_FORMAT = "dd/MM/yyyy HH:mm:ss"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
MONTH_FORMAT = "yyyy-MM"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class LoyaltyConfig:
    """Parameters of the loyalty datasets; defaults reproduce the shop setup."""

    brands: tuple = BRANDS
    funnel_brands: tuple = FUNNEL_BRANDS
    cancelled_status: str = CANCELLED_STATUS
    gift_category: str = GIFT_CATEGORY
    no_username: str = NO_USERNAME
    confused_max_days: float = CONFUSED_MAX_DAYS
    phases: tuple = PHASES
    # K7: a three-way first-purchase tie falls into the first pair branch
    # ("Start with Kinka and Revy"); set True to give it its own group.
    three_way_ties_first: bool = False
    # K2: integer / integer truncates (as the shop's SQL did on integer text)
    truncate_integer_ratio: bool = True

    def __post_init__(self):
        if len(self.funnel_brands) != 3:
            raise ValueError(f"the funnel rules are stated for 3 brands, not {len(self.funnel_brands)}")

    def brand_suffix(self, brand: str) -> str:
        return dict(self.brands)[brand]


DEFAULT_CONFIG = LoyaltyConfig()
