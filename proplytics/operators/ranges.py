"""Rows meet the bands that hold their value: equality joins on blocks of a hierarchy, no nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.operators.alerts import LEVELS, TOP, _block, _blocks


def _place(value: Column) -> Column:
    """The step of a value: whole numbers from 0 on; what lies beyond counts as the first or the last step."""
    # greatest and least pass nulls over
    return F.when(value.isNotNull(), F.least(F.greatest(F.floor(value).cast("bigint"), F.lit(0)), F.lit(TOP))).cast("bigint")


def band_join(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str, on: list[str]) -> DataFrame:
    """Rows with the columns of each band of equal ``on`` with ``low`` <= value < ``high``; null is no bound. Rows without a band stay once, with nulls.

    A band is a few blocks of its range, a value lies in one block of every level, so values only meet bands that hold their step. A value is
    looked up once, however many rows have it. Null values, NaN and null ``on`` meet no band; bands may overlap. Other columns must not have equal names.
    """
    first, last = F.coalesce(_place(F.col(low)), F.lit(0)).cast("bigint"), F.coalesce(_place(F.col(high)), F.lit(TOP)).cast("bigint")
    index = bands.withColumn("_b", F.explode(F.when(first <= last, _blocks(first, last)))).select("*", "_b.level", "_b.block").drop("_b")
    probes = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda n: _block(n, F.call_function("shiftright", _place(F.col(value)), 2 * n)))
    values = rows.select(*on, value).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).distinct()
    met = values.select("*", F.explode(probes).alias("_p")).select("*", "_p.level", "_p.block").drop("_p").join(index, [*on, "level", "block"])
    within = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    return rows.join(met.where(within).drop("level", "block"), [*on, value], "left")
