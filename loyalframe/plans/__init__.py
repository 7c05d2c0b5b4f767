from loyalframe.plans.pipeline import LoyaltyData, present_lines  # noqa: F401
