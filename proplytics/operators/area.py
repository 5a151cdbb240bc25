"""Outlook of areas: price trends by grid cell, rolled up to larger cells where sales are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: digits of the grid codes of levels 3, 2, 1
DIGITS = {3: 8, 2: 6, 1: 4}
MIN_SALES = 30
#: yearly change of prices in percent from which an area grows or declines
TURN = 1.0
EPOCH = "1990-01-01"

MOMENTS = ["n", "t", "tt", "y", "ty"]


def moments(rows: DataFrame, code: str, day: str, value: str) -> DataFrame:
    """Sums of a regression of ``value`` (a long) on days, for each finest code; such sums of parts add up to the sums of the whole.

    Sums are whole numbers of 38 digits, so no order of adding changes them. Rows without code, day or value take no part.
    """
    whole = "decimal(38,0)"
    t, y = F.datediff(F.col(day), F.lit(EPOCH).cast("date")).cast("long"), F.col(value).cast("long")
    known = rows.where(F.col(code).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull()).select(F.col(code).alias("code"), t.alias("_t"), y.alias("_y"))
    t, y = F.col("_t").cast("decimal(18,0)"), F.col("_y").cast("decimal(18,0)")
    terms = {"t": t, "tt": t * t, "y": y, "ty": t * y}
    return known.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).cast(whole).alias(k) for k, v in terms.items()])


def roll_up(cells: DataFrame) -> DataFrame:
    """``cells`` of level 3 and the sums of their parents: (level, code, moments). Each level is added up from the one below."""
    out = cells.select(F.lit(3).alias("level"), "code", *MOMENTS)
    below = out
    for level in (2, 1):
        up = below.groupBy(F.substring("code", 1, DIGITS[level]).alias("code")).agg(*[F.sum(m).cast(cells.schema[m].dataType).alias(m) for m in MOMENTS])
        below = up.select(F.lit(level).alias("level"), "code", *MOMENTS)
        out = out.unionByName(below)
    return out


def _slope() -> Column:
    n, t, tt, y, ty = (F.col(m).cast("double") for m in MOMENTS)
    spread = n * tt - t * t
    return F.when(spread > 0, (n * ty - t * y) / spread)


def price_trend(sales: DataFrame, code: str = "mesh_code", day: str = "day", value: str = "unit_price") -> DataFrame:
    """level, code, n, mean value and yearly change in percent of the mean, for cells of levels 1 to 3.

    The change is null where all sales are of one day or the mean is not positive.
    """
    mean = F.col("y").cast("double") / F.col("n")
    change = F.when(mean > 0, F.round(_slope() * F.lit(365.25) / mean * F.lit(100.0), 3))
    return roll_up(moments(sales, code, day, value)).select("level", "code", "n", F.round(mean, 2).alias("mean_value"), change.alias("yearly_change"))


def outlook(cells: DataFrame, trend: DataFrame, code: str = "mesh_code", least: int = MIN_SALES) -> DataFrame:
    """``cells`` of level 3 with the change of the smallest cell around them that has ``least`` sales and a change.

    Adds source_level (null: none found), n (sales of that cell), yearly_change and outlook: ``growing``, ``declining``, ``stable`` or ``unknown``.
    """
    good = trend.where((F.col("n") >= least) & F.col("yearly_change").isNotNull())
    found = cells
    for level, digits in DIGITS.items():
        part = good.where(F.col("level") == level).select(F.col("code").alias(f"_c{level}"), F.struct(F.col("level").alias("source_level"), "n", "yearly_change").alias(f"_v{level}"))
        found = found.join(part, F.substring(F.col(code), 1, digits) == F.col(f"_c{level}"), "left")
    change = F.col("yearly_change")
    word = F.when(change.isNull(), "unknown").when(change >= TURN, "growing").when(change <= -TURN, "declining").otherwise("stable")
    best = F.coalesce(*[F.col(f"_v{level}") for level in DIGITS])
    return found.withColumn("_best", best).select(*cells.columns, "_best.*").withColumn("outlook", word)
