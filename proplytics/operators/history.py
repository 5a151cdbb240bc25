"""Price histories as validity intervals, as-of joins, and listings that crawls stop finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Neighbouring rows (by valid_from) of equal ``value`` as one row from the first valid_from to the last last_seen."""
    order = Window.partitionBy(*keys).orderBy("valid_from")
    changed = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = rows.withColumn("_new", changed).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min("valid_from").alias("valid_from"), F.max("last_seen").alias("last_seen"), F.min(value).alias(value)).drop("_run")


def price_history(sightings: DataFrame, keys: list[str], value: str = "price", time: str = "scraped_at", block: str = "month") -> DataFrame:
    """keys, version, value, previous value, valid_from, last_seen, valid_to: one row for each stretch of equal values.

    Stretches are found within blocks of time first and then joined at their seams, so that a key with very many sightings is
    the work of many tasks and only its stretches meet. Intervals of a key do not overlap and leave no gap; the last one is open.
    Sightings without a value or time say nothing; of several values at one time the smallest counts.
    """
    known = sightings.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    points = known.groupBy(*keys, F.col(time).alias("valid_from")).agg(F.min(value).alias(value)).withColumn("last_seen", F.col("valid_from"))
    return _joined(_runs(points.withColumn("_block", F.date_trunc(block, "valid_from")), [*keys, "_block"], value), keys, value)


def _joined(stretches: DataFrame, keys: list[str], value: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("valid_from")
    return _runs(stretches, keys, value).select(
        *keys, F.row_number().over(order).cast("bigint").alias("version"), value, F.lag(value).over(order).alias(f"previous_{value}"), "valid_from", "last_seen",
        F.lead("valid_from").over(order).alias("valid_to"))


def with_late(history: DataFrame, late: DataFrame, keys: list[str], value: str = "price", time: str = "scraped_at") -> DataFrame:
    """``history`` after sightings that arrive late: those that fall into an interval with another value split it.

    An interval stands for two sightings, its first and its last; between them the earlier value holds. Keys without late rows are
    passed on as they are.
    """
    known = late.where(F.col(value).isNotNull() & F.col(time).isNotNull())
    touched = known.select(*keys).distinct()
    ends = history.join(touched, keys, "left_semi").select(*keys, value, F.explode(F.array_distinct(F.array("valid_from", "last_seen"))).alias("valid_from"))
    points = ends.unionByName(known.select(*keys, value, F.col(time).alias("valid_from")))
    points = points.groupBy(*keys, "valid_from").agg(F.min(value).alias(value)).withColumn("last_seen", F.col("valid_from"))
    return history.join(touched, keys, "left_anti").unionByName(_joined(points, keys, value))


def price_drops(history: DataFrame, keys: list[str], value: str = "price") -> DataFrame:
    """Every interval that is cheaper than the one before: by how much, and how much below the first price."""
    first = history.where("version = 1").select(*keys, F.col(value).alias("first_price"))
    dropped = history.where(F.col(value) < F.col(f"previous_{value}"))
    return dropped.join(first, keys).select(
        *keys, "version", value, F.col("valid_from").alias("dropped_at"), (F.col(f"previous_{value}") - F.col(value)).alias("drop"),
        (F.col("first_price") - F.col(value)).alias("below_first"))


def as_of(asked: DataFrame, history: DataFrame, keys: list[str], time: str, columns: list[str], start: str = "valid_from", block: str = "month") -> DataFrame:
    """``asked`` with ``columns`` of the latest row of ``history`` that starts at ``time`` or before; null where there is none.

    Both sides are merged within (keys, block of time); what a block begins with is the last row of the blocks before it, found on
    one row a block. No task holds all rows of a key. A null time finds nothing. Of rows that start together the largest counts.
    """
    value = F.struct(*columns)
    started = history.where(F.col(start).isNotNull()).groupBy(*keys, F.col(start).alias("_t")).agg(F.max(value).alias("_v")).withColumn("_block", F.date_trunc(block, "_t"))
    row = F.struct(*asked.columns)
    timed = asked.select(*keys, F.col(time).alias("_t"), row.alias("_row")).withColumn("_block", F.date_trunc(block, "_t"))
    both = started.select(*keys, "_block", "_t", F.lit(0).alias("_side"), "_v", F.lit(None).cast(timed.schema["_row"].dataType).alias("_row")).unionByName(
        timed.select(*keys, "_block", "_t", F.lit(1).alias("_side"), F.lit(None).cast(started.schema["_v"].dataType).alias("_v"), "_row"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("_found", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    # one row for each block of either side
    blocks = both.groupBy(*keys, "_block").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    same = [merged[k].eqNullSafe(carried[k]) for k in [*keys, "_block"]]
    joined = merged.join(carried, _all(same), "left").select("_row", F.when(F.col("_t").isNotNull(), F.coalesce("_found", "_carried")).alias("_hit"))
    return joined.select("_row.*", *(F.col("_hit")[c].alias(c) for c in columns))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def delistings(sightings: DataFrame, runs: DataFrame, source: str = "source", listing: str = "listing_id", run: str = "run_day", missed: int = 3) -> DataFrame:
    """source, listing, event, run, last_seen: when a listing was taken for gone, and when it came back.

    ``runs`` (source, run) says when each source was crawled, ``sightings`` which listing a run found. A listing is delisted by the
    ``missed``-th run in a row that does not find it, once a later run of its source has begun, and relisted by the run that finds
    it again. Runs are numbered per source; a listing's sightings are folded into islands of runs without a long gap.
    """
    numbered = runs.select(source, run).dropna().distinct()
    numbered = numbered.withColumn("_no", F.row_number().over(Window.partitionBy(source).orderBy(run)))
    last = numbered.groupBy(source).agg(F.max("_no").alias("_last"))
    seen = sightings.select(source, listing, run).dropna().distinct().join(numbered, [source, run])
    order = Window.partitionBy(source, listing).orderBy("_no")
    gaps = seen.withColumns({"_next": F.lead("_no").over(order), "_back": F.lead(run).over(order)}).join(last, source)
    gone = gaps.where(F.coalesce(F.col("_next"), F.col("_last")) > F.col("_no") + missed)
    third = numbered.select(F.col(source), F.col("_no").alias("_third"), F.col(run).alias("_gone_at"))
    gone = gone.withColumn("_third", F.col("_no") + missed).join(third, [source, "_third"])
    events = F.array(F.struct(F.lit("delisted").alias("event"), F.col("_gone_at").alias("at")), F.struct(F.lit("relisted").alias("event"), F.col("_back").alias("at")))
    rows = gone.select(source, listing, F.col(run).alias("last_seen"), F.explode(events).alias("_e")).where(F.col("_e.at").isNotNull())
    return rows.select(source, listing, F.col("_e.event").alias("event"), F.col("_e.at").alias(run), "last_seen")
