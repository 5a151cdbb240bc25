"""Market statistics: counts, averages, histogram and breakdowns, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proplytics.functions.numbers import round_exact
from proplytics.sources.dimensions import PRICE_BUCKETS, dimension


def _active() -> Column:
    return F.col("status") == "active"


def _rounded_avg(c: Column) -> Column:
    """Average rounded half-even to a whole number; null when there is none or it is zero."""
    return F.nullif(F.bround(F.avg(c), 0), F.lit(0.0)).cast("bigint")


def _score_mean(c: Column) -> Column:
    """Mean of scores, summed in whole hundredths so that the order of rows cannot move a tie."""
    hundredths = F.round(c * F.lit(100.0)).cast("bigint")
    return F.try_divide(F.sum(hundredths).cast("double"), F.count(c)) / F.lit(100.0)


def _score_avg(c: Column) -> Column:
    return F.nullif(round_exact(_score_mean(c), 1), F.lit(0.0))


def market_stats(properties: DataFrame) -> DataFrame:
    """Totals, averages and rebuild breakdown: one scan, one partial and one final aggregate."""
    a = _active()
    ok, ng = F.count_if(a & F.col("rebuild_possible")), F.count_if(a & ~F.col("rebuild_possible"))
    return properties.agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.count_if(a).alias("active_properties"),
        _rounded_avg(F.when(a, F.col("price_jpy"))).alias("avg_price"),
        _score_avg(F.col("composite_score")).alias("avg_score"),
        ok.alias("rebuild_ok"),
        ng.alias("rebuild_ng"),
        (F.count_if(a) - ok - ng).alias("rebuild_unknown"),
    )


def bucket_of(price: Column) -> Column:
    """Lower bound of the price's bucket, null outside all."""
    result = None
    for lo, hi, _ in PRICE_BUCKETS:
        hit, value = (price >= lo) & (price < hi), F.lit(lo).cast("bigint")
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def price_histogram(properties: DataFrame) -> DataFrame:
    """Active properties per price bucket, empty buckets with 0.

    The bucket is an expression of the price, so the rows aggregate map-side to six keys and
    only those meet the bucket dimension.
    """
    counts = (
        properties.where(_active())
        .select(bucket_of(F.col("price_jpy")).alias("lo"))
        .where(F.col("lo").isNotNull())
        .groupBy("lo")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    buckets = dimension(properties.sparkSession, "price_buckets")
    return buckets.join(counts, "lo", "left").select(
        "label",
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("count"),
    )


def histogram_bars(histogram: DataFrame) -> DataFrame:
    """Bar width per bucket as a percentage of the largest, at least 2. Six rows, one window."""
    top = F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1).cast("bigint"))
    share = F.col("count").cast("double") / top * F.lit(100.0)
    return histogram.withColumn("width_pct", F.greatest(F.lit(2.0), share))


def municipality_stats(properties: DataFrame) -> DataFrame:
    a = _active()
    return properties.groupBy("municipality_code").agg(
        F.count_if(a).alias("property_count"),
        F.coalesce(F.bround(F.avg(F.when(a, F.col("price_jpy"))), 0), F.lit(0.0)).cast("bigint").alias("avg_price"),
        _score_avg(F.col("composite_score")).alias("avg_score"),
    )


def rebuild_shares(properties: DataFrame) -> DataFrame:
    """Rebuild rate and stacked shares of the active stock, rounded half up; null without any."""
    stats = market_stats(properties.withColumn("composite_score", F.lit(None).cast("double")))

    def share(name: str) -> Column:
        part = F.try_divide(F.col(name).cast("double"), F.nullif(F.col("active_properties"), F.lit(0)))
        return F.floor(part * F.lit(100.0) + F.lit(0.5)).cast("bigint")

    return stats.select(
        "active_properties",
        share("rebuild_ok").alias("ok_pct"),
        share("rebuild_ng").alias("ng_pct"),
        share("rebuild_unknown").alias("unknown_pct"),
    )


def coverage_by_source(properties: DataFrame, listings: DataFrame) -> DataFrame:
    """Coordinate coverage of active properties per portal."""
    p = properties.where(_active()).select("id", "lat")
    joined = p.join(listings.select("source", "property_id"), F.col("id") == F.col("property_id"))
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("lat").alias("has_coords"),
        (F.count(F.lit(1)) - F.count("lat")).alias("missing_coords"),
    )


def page_averages(rows: DataFrame) -> DataFrame:
    """Averages over one page of records: scored rows and priced rows, rounded half up."""

    def half_up(mean: Column) -> Column:
        return F.floor(mean + F.lit(0.5)).cast("bigint")

    return rows.agg(
        half_up(_score_mean(F.col("composite_score"))).alias("avg_score"),
        half_up(F.avg("price_jpy")).alias("avg_price"),
        F.count_if(_active()).alias("active_count"),
    )


def map_extent(properties: DataFrame) -> DataFrame:
    return properties.agg(
        F.min("lng").alias("min_lng"),
        F.min("lat").alias("min_lat"),
        F.max("lng").alias("max_lng"),
        F.max("lat").alias("max_lat"),
    )


def map_clusters(properties: DataFrame, zoom: int) -> DataFrame:
    """Point counts per map cell about 50 px wide, with the display step of each cell.

    Up to zoom 14 cells are grouped; beyond it every point stands alone, as on the map.
    """
    from proplytics.functions.geo import tile_x, tile_y

    located = properties.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if zoom > 14:
        return located.select(
            F.col("id").cast("string").alias("cell"), F.lit(1).cast("bigint").alias("n"), "lat", "lng",
            F.lit("point").alias("step"),
        )
    # a tile is 512 px in the map client: eight cells per axis are close to 50 px
    deep = zoom + 3
    cell = F.concat_ws("/", F.lit(zoom), tile_x(F.col("lng"), deep), tile_y(F.col("lat"), deep))
    n = F.count(F.lit(1))
    step = F.when(n == 1, "point").when(n < 10, "small").when(n < 50, "medium").when(n < 200, "large").otherwise("huge")
    return located.groupBy(cell.alias("cell")).agg(
        n.alias("n"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), step.alias("step")
    )


def recent_transactions(
    transactions: DataFrame, limit: int, municipality_code: str | None = None, property_type: str | None = None
) -> DataFrame:
    """Newest transactions, filtered first, then a top-k."""
    if municipality_code:
        transactions = transactions.where(F.col("municipality_code") == municipality_code)
    if property_type:
        transactions = transactions.where(F.col("property_type") == property_type)
    return transactions.orderBy(F.col("created_at").desc_nulls_first(), F.col("id")).limit(limit)
