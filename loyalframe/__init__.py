"""loyalframe — shop loyalty analytics as lazy Spark DataFrame plans.

Order lines + a product label table go in; order, customer, monthly,
product and switching datasets plus chart feeds come out, each a
``DataFrame -> DataFrame`` function built from Spark's built-in
expressions (no Python UDFs).
"""

from loyalframe.config import LoyaltyConfig, DEFAULT_CONFIG

__all__ = ["LoyaltyConfig", "DEFAULT_CONFIG"]
