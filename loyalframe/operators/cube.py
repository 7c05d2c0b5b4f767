"""One pass over the buyers for all their summaries.

Loyalty tiers, funnel groups, switching states and entry months have small
vocabularies, and every summary over buyers (A3, A7-A11, A13, A14) adds up
counts and sums of buyers within some of them. :func:`customer_cube` takes
these sums once per combination that occurs; a summary is then a roll-up of
some thousand rows. The summary functions accept either the buyers or the
cube and give equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUBE_KEYS = ("Loyalty_Tier", "Funnel_Group", "Switching_Status", "Entry_Month")
MARK = "_Cube_Rows"  # buyers of a combination


def is_cube(frame: DataFrame) -> bool:
    return MARK in frame.columns


def roll_up(cube: DataFrame, keys: list, sums: list) -> DataFrame:
    """``sums`` of the cube per ``keys``, with their types kept."""
    types = {f.name: f.dataType for f in cube.schema.fields}
    return cube.groupBy(*keys).agg(*[F.sum(c).cast(types[c]).alias(c) for c in sums])


def buyers_in(frame: DataFrame, name: str):
    """The number of buyers, as an aggregate over buyers or over the cube."""
    return (F.sum(MARK) if is_cube(frame) else F.count("Buyer_Username")).alias(name)


def entry_month(frame: DataFrame, month_of) -> F.Column:
    """Month of the first order: a key of the cube, else ``month_of`` the buyer's time."""
    return F.col("Entry_Month") if is_cube(frame) else month_of("First_Seen_Ts")
