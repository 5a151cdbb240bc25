"""Property search: filters, order, pages, and the record, GeoJSON and CSV projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.functions.numbers import blank_zero, iso_timestamp


@dataclass(frozen=True)
class Filters:
    """Search conditions; None means no condition."""

    search: str | None = None
    price_min: int | None = None
    price_max: int | None = None
    prefecture_code: str | None = None
    municipality_code: str | None = None
    min_score: float | None = None
    rebuild_possible: bool | None = None
    status: str | None = "active"
    located: bool = False


def conditions(f: Filters) -> list[Column]:
    """Plain column predicates, so that Parquet sees each of them."""
    c, out = F.col, []
    if f.status is not None:
        out.append(c("status") == f.status)
    if f.search:
        out.append(c("address_ja").ilike(f"%{f.search}%"))
    if f.price_min is not None:
        out.append(c("price_jpy") >= f.price_min)
    if f.price_max is not None:
        out.append(c("price_jpy") <= f.price_max)
    if f.prefecture_code:
        out.append(c("prefecture_code") == f.prefecture_code)
    if f.municipality_code:
        out.append(c("municipality_code") == f.municipality_code)
    if f.min_score is not None:
        out.append(c("composite_score") >= f.min_score)
    if f.rebuild_possible is not None:
        out.append(c("rebuild_possible") == f.rebuild_possible)
    if f.located:
        out += [c("lat").isNotNull(), c("lng").isNotNull()]
    return out


def find(df: DataFrame, f: Filters) -> DataFrame:
    for condition in conditions(f):
        df = df.where(condition)
    return df


def ordered(df: DataFrame, sort_by: str = "created_at", descending: bool = True, key: str = "id") -> DataFrame:
    """Order by a column the caller names; an unknown one falls back to created_at.

    Nulls come last ascending and first descending; ``key`` makes the order total.
    """
    name = sort_by if sort_by in df.columns else "created_at"
    order = F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()
    return df.orderBy(order, F.col(key))


def page(df: DataFrame, number: int = 1, size: int = 50, **order) -> DataFrame:
    """One page; planned as a top-k of offset + size, not as a full sort."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page starts at 1 and holds 1 to 200 rows")
    return ordered(df, **order).offset((number - 1) * size).limit(size)


def newest(df: DataFrame, n: int, by: str = "created_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_first(), F.col(key)).limit(n)


def page_count(df: DataFrame, size: int = 50) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.ceil(total / F.lit(size)).cast("bigint").alias("pages"))


def lookup(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Keyed lookup of many ids at once; a miss stays as a row with found = false."""
    hit = table.withColumn("found", F.lit(True))
    return keys.join(hit, key, "left").withColumn("found", F.coalesce(F.col("found"), F.lit(False)))


def record(df: DataFrame) -> DataFrame:
    """Client record: renamed coordinates and price, zeros of optional numbers shown as null."""
    zero_is_null = ["land_area_sqm", "road_width_m", "composite_score", "price_per_sqm", "building_area_sqm",
                    "coverage_ratio", "floor_area_ratio"]
    picks = [F.col("id").cast("string").alias("id")]
    for name in df.columns:
        if name == "id":
            continue
        column = F.col(name)
        if name in zero_is_null:
            column = blank_zero(column)
        if name in ("created_at", "updated_at"):
            column = iso_timestamp(column)
        picks.append(column.alias({"lat": "latitude", "lng": "longitude", "price_jpy": "price"}.get(name, name)))
    return df.select(*picks)


def geojson_features(df: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per located row; null members are kept."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("id").cast("string").alias("id"),
            F.col("price_jpy").alias("price"),
            blank_zero(F.col("composite_score")).alias("score"),
            F.col("address_ja").alias("address"),
            F.col("floor_plan").alias("floor_plan"),
            blank_zero(F.col("land_area_sqm")).alias("land_area"),
            F.col("year_built").alias("year_built"),
            F.col("rebuild_possible").alias("rebuild_possible"),
        ).alias("properties"),
    )
    located = df.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return located.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _truthy(c: Column) -> Column:
    """Text of a number, empty for null and zero."""
    return F.when(c != 0, c.cast("string")).otherwise("")


def tri_state(c: Column) -> Column:
    return F.when(c, "true").when(~c, "false").otherwise("")


CSV_NUMBERS = ["land_area_sqm", "building_area_sqm", "road_width_m", "composite_score", "year_built"]


def csv_rows(df: DataFrame) -> DataFrame:
    """The 17 export columns as text."""
    c = {n: (F.col(n) if n in df.columns else F.lit(None).cast("double")) for n in
         ["building_area_sqm", "composite_score", "city_planning_zone"]}
    return df.select(
        F.col("id").cast("string").alias("id"),
        _blank(F.col("address_ja")).alias("address"),
        _blank(F.col("price_jpy")).alias("price"),
        _truthy(F.col("land_area_sqm")).alias("land_area_sqm"),
        _truthy(c["building_area_sqm"]).alias("building_area_sqm"),
        _blank(F.col("floor_plan")).alias("floor_plan"),
        _truthy(F.col("year_built")).alias("year_built"),
        _blank(F.col("structure")).alias("structure"),
        _truthy(F.col("road_width_m")).alias("road_width_m"),
        tri_state(F.col("rebuild_possible")).alias("rebuild_possible"),
        _truthy(c["composite_score"]).alias("composite_score"),
        _blank(c["city_planning_zone"]).alias("city_planning_zone"),
        _blank(F.col("use_zone")).alias("use_zone"),
        _truthy(F.col("lat")).alias("latitude"),
        _truthy(F.col("lng")).alias("longitude"),
        F.col("status"),
        _blank(iso_timestamp(F.col("created_at"))).alias("created_at"),
    )


def export_properties(df: DataFrame, f: Filters, limit: int | None = None) -> DataFrame:
    """Matching properties as CSV rows, newest first; all of them, or the caller's ``limit``."""
    found = find(df, f)
    return csv_rows(ordered(found) if limit is None else newest(found, limit))


def export_deals(deals: DataFrame) -> DataFrame:
    """All deals, newest first, as CSV rows (a range-partitioned sort, no single task)."""

    def optional(name: str) -> Column:
        return F.col(name) if name in deals.columns else F.lit(None).cast("string")

    rows = deals.orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    return rows.select(
        F.col("id").cast("string").alias("id"),
        F.col("property_id").cast("string").alias("property_id"),
        "stage",
        _truthy(F.col("purchase_price")).alias("purchase_price"),
        _truthy(F.col("renovation_budget")).alias("renovation_budget"),
        _truthy(F.col("target_sale_price")).alias("target_sale_price"),
        _blank(optional("notes")).alias("notes"),
        _blank(iso_timestamp(F.col("created_at"))).alias("created_at"),
        _blank(iso_timestamp(optional("updated_at").cast("timestamp_ntz"))).alias("updated_at"),
    )


def with_listings(properties: DataFrame, listings: DataFrame) -> DataFrame:
    """Each property with its listings, one row per listing (one with nulls when it has none).

    Rows stay flat: a property that a third of all listings point at must not become one value.
    """
    side = listings.withColumnsRenamed({"id": "listing_id", "status": "listing_status"})
    return properties.join(side, properties["id"] == side["property_id"], "left").drop(side["property_id"])


def listing_summary(properties: DataFrame, listings: DataFrame) -> DataFrame:
    """Listing count and last sighting per property; counted before the join, so skew stays local."""
    counts = listings.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("n_listings"), F.max("scraped_at").alias("last_scraped_at")
    )
    joined = properties.join(counts, properties["id"] == counts["property_id"], "left").drop("property_id")
    return joined.withColumn("n_listings", F.coalesce(F.col("n_listings"), F.lit(0).cast("bigint")))
