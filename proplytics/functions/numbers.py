"""Column expressions for money, area, scores and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQM_PER_TSUBO = 3.30579


def round_exact(c: Column, places: int) -> Column:
    """Round a double by its exact binary value, ties to even.

    Spark's round and bround work on the shortest decimal text of the double, which
    moves 0.15 to 0.2; number formatting keeps the binary value.
    """
    pattern = "0" if places == 0 else "0." + "0" * places
    return F.call_function("format_number", c.cast("double"), F.lit(pattern)).cast("double")


def fixed(c: Column, places: int = 1) -> Column:
    """Text with a fixed number of decimals."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * places))


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """``c`` held within the bounds; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def blank_zero(c: Column) -> Column:
    """Null for zero, as the record projections and exports show it."""
    return F.nullif(c, F.lit(0).cast("double"))


def format_yen(amount: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(amount.cast("bigint"), 0))


def yen_to_man(amount: Column) -> Column:
    return amount.cast("double") / F.lit(10_000.0)


def man_to_yen(man: Column) -> Column:
    return (man.cast("double") * F.lit(10_000.0)).cast("bigint")


def format_man_yen(amount: Column) -> Column:
    man = yen_to_man(amount)
    whole = man == F.floor(man)
    return F.concat(F.when(whole, man.cast("bigint").cast("string")).otherwise(fixed(man)), F.lit("万円"))


def sqm_to_tsubo(sqm: Column) -> Column:
    return round_exact(sqm / F.lit(SQM_PER_TSUBO), 2)


def tsubo_to_sqm(tsubo: Column) -> Column:
    return round_exact(tsubo * F.lit(SQM_PER_TSUBO), 2)


def price_per_tsubo(price: Column, area_sqm: Column) -> Column:
    tsubo = sqm_to_tsubo(area_sqm)
    per = F.try_divide(price.cast("double"), tsubo).cast("bigint")
    return F.when((area_sqm <= 0) | (tsubo <= 0), F.lit(0).cast("bigint")).otherwise(per)


def area_label(sqm: Column) -> Column:
    return F.concat(fixed(sqm), F.lit("m² ("), fixed(sqm_to_tsubo(sqm)), F.lit("坪)"))


def price_per_sqm(price: Column, area: Column) -> Column:
    """Price over land area where both are present, non-zero and the area positive."""
    return F.when((price != 0) & (area > 0), price.cast("double") / area)


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def pga_band(pga: Column) -> Column:
    return (
        F.when(pga.isNull(), "none").when(pga < 0.1, "low").when(pga < 0.3, "moderate").when(pga < 0.6, "high")
        .otherwise("severe")
    )


def flood_band(depth: Column) -> Column:
    return (
        F.when(depth.isNull(), "none").when(depth <= 0, "low").when(depth < 0.5, "moderate").when(depth < 3, "high")
        .otherwise("severe")
    )


# First western year of each era
ERA_STARTS = [(2019, "令和", 2018), (1989, "平成", 1988), (1926, "昭和", 1925), (1912, "大正", 1911), (1868, "明治", 1867)]

# Statutory useful life in years by structure code
USEFUL_LIFE = {"wood": 22, "steel_frame": 34, "rc": 47, "src": 47, "light_steel": 27}

REFERENCE_YEAR = 2026


def year_to_era(year: Column) -> Column:
    """2024 → 令和6年; years before 1868 stay western."""
    text = F.concat(year.cast("string"), F.lit("年"))
    for start, era, base in reversed(ERA_STARTS):
        text = F.when(year >= start, F.concat(F.lit(era), (year - base).cast("string"), F.lit("年"))).otherwise(text)
    return text


def building_age(year_built: Column, as_of_year: int = REFERENCE_YEAR) -> Column:
    return F.when(year_built.isNotNull(), F.greatest(F.lit(0), F.lit(as_of_year) - year_built))


def depreciation_remaining(year_built: Column, structure: Column, as_of_year: int = REFERENCE_YEAR) -> Column:
    life = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in USEFUL_LIFE.items() for x in p]), structure), F.lit(22)
    )
    return F.when(year_built.isNotNull(), F.greatest(F.lit(0), life - (F.lit(as_of_year) - year_built)))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two zone-less timestamps."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros.cast("double") / F.lit(1_000_000.0)


def duration_label(seconds: Column) -> Column:
    """``42s`` below a minute, else ``3m 5s``."""
    whole = F.floor(seconds + F.lit(0.5)).cast("bigint")
    minutes = F.floor(whole / F.lit(60)).cast("bigint")
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(
        F.concat(minutes.cast("string"), F.lit("m "), (whole - minutes * 60).cast("string"), F.lit("s"))
    )


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
