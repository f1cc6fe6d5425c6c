"""Score ladder and card tiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


# The ladder of scores and the bounds and names of the tiers below.
def score(platforms: Column) -> Column:
    """1.0 for one platform, half a point for each further one, at most 2.5."""
    return (F.lit(1.0) + F.least(platforms - 1, F.lit(3)) * F.lit(0.5)).cast("float")


def tier(value: Column, *bounds: tuple[float, str], otherwise: str) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for bound, label in bounds:
        chain = chain.when(value >= bound, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def score_tier(c: Column) -> Column:
    return tier(c, (2.5, "magenta"), (2.0, "yellow"), (1.5, "cyan"), otherwise="gray")


def platform_tier(c: Column) -> Column:
    return tier(c, (4, "magenta"), (3, "yellow"), (2, "cyan"), otherwise="gray")
