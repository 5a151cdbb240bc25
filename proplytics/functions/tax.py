"""Transaction taxes and fees as columns. Amounts are whole yen, floored at each step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proplytics.sources.dimensions import STAMP_BRACKETS

# Statutory rates and amounts
CONSUMPTION_TAX = 0.10
LOW_PRICE_THRESHOLD = 8_000_000
LOW_PRICE_COMMISSION = 330_000
REGISTRATION_LAND = 0.015
REGISTRATION_BUILDING = 0.020
REGISTRATION_MORTGAGE = 0.004
ACQUISITION_RATE = 0.03
ACQUISITION_LAND_SHARE = 0.5
LAND_SHARE = 0.4
ASSESSED_SHARE = 0.7
FIXED_ASSET_TAX = 0.014
CITY_PLANNING_TAX = 0.003
SHORT_TERM_RATE = 0.3963
LONG_TERM_RATE = 0.20315
SHORT_TERM_MONTHS = 60
SCRIVENER_FEE = 50_000


def yen(c: Column) -> Column:
    """Whole yen, rounded down."""
    return F.floor(c).cast("bigint")


def _share(amount: Column, rate: float) -> Column:
    return yen(amount.cast("double") * F.lit(rate))


def commission_standard(price: Column) -> Column:
    """Legal maximum before consumption tax, as a double."""
    p = price.cast("double")
    return (
        F.when(price <= 2_000_000, p * F.lit(0.05))
        .when(price <= 4_000_000, p * F.lit(0.04) + F.lit(22_000.0))
        .otherwise(p * F.lit(0.03) + F.lit(66_000.0))
    )


def commission_with_tax(price: Column) -> Column:
    return yen(commission_standard(price) * F.lit(1 + CONSUMPTION_TAX))


def commission(price: Column) -> Column:
    """Charged per side: a flat amount up to the low-price threshold, zero included."""
    return F.when(price <= LOW_PRICE_THRESHOLD, F.lit(LOW_PRICE_COMMISSION).cast("bigint")).otherwise(
        commission_with_tax(price)
    )


def stamp_tax(amount: Column) -> Column:
    """Bracket lookup; nine brackets fold into one conditional, so no join is needed."""
    result = F.when(amount < 0, F.lit(0).cast("bigint"))
    for upper, tax in STAMP_BRACKETS:
        value = F.lit(tax).cast("bigint")
        result = result.when(amount <= upper, value) if upper is not None else result.otherwise(value)
    return F.when(amount.isNotNull(), result)


def land_value(assessed: Column) -> Column:
    return _share(assessed, LAND_SHARE)


def registration_land(assessed: Column, land_only: Column) -> Column:
    return _share(F.when(land_only, assessed).otherwise(land_value(assessed)), REGISTRATION_LAND)


def registration_building(assessed: Column, land_only: Column) -> Column:
    return F.when(land_only, F.lit(0).cast("bigint")).otherwise(
        _share(assessed - land_value(assessed), REGISTRATION_BUILDING)
    )


def acquisition_land(assessed: Column, land_only: Column) -> Column:
    base = F.when(land_only, assessed).otherwise(land_value(assessed))
    return yen(base.cast("double") * F.lit(ACQUISITION_LAND_SHARE) * F.lit(ACQUISITION_RATE))


def acquisition_building(assessed: Column, land_only: Column) -> Column:
    return F.when(land_only, F.lit(0).cast("bigint")).otherwise(
        _share(assessed - land_value(assessed), ACQUISITION_RATE)
    )


def default_assessed(price: Column) -> Column:
    return _share(price, ASSESSED_SHARE)


def annual_holding(assessed: Column) -> Column:
    return _share(assessed, FIXED_ASSET_TAX) + _share(assessed, CITY_PLANNING_TAX)


def monthly_holding(assessed: Column) -> Column:
    return yen(annual_holding(assessed) / F.lit(12.0))


def gains_rate(gain: Column, months: Column) -> Column:
    return F.when(gain <= 0, F.lit(0.0)).when(months <= SHORT_TERM_MONTHS, F.lit(SHORT_TERM_RATE)).otherwise(
        F.lit(LONG_TERM_RATE)
    )


def gains_tax(gain: Column, months: Column) -> Column:
    return F.when(gain <= 0, F.lit(0).cast("bigint")).otherwise(yen(gain.cast("double") * gains_rate(gain, months)))
