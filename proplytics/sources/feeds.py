"""Landed feeds: JSON envelopes, GeoJSON responses, tile presence, seed dimensions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proplytics.functions.text import first_group

# Known raster and vector tile layers
RASTER_LAYERS = ["flood", "tsunami", "landslide", "steep_slope", "storm_surge"]
VECTOR_LAYERS = {"disaster_zone": "XKT016", "landslide_prevention": "XKT021", "steep_slope_zone": "XKT022",
                 "land_price": "XPT001", "price_indicator": "XPT002", "elementary_school": "XKT004",
                 "middle_school": "XKT005", "high_school": "XKT006", "medical": "XKT010",
                 "population_mesh": "XKT013", "station": "XKT015"}
TILE_LAYERS = RASTER_LAYERS + list(VECTOR_LAYERS)

FEATURE_COLLECTION = "type string, features array<struct<type: string, properties: map<string,string>>>"

TRANSACTION_ENVELOPE = (
    "status string, data array<struct<Type: string, MunicipalityCode: string, DistrictName: string, TradePrice: string, "
    "UnitPrice: string, Area: string, BuildingYear: string, Structure: string, Period: string>>"
)
MUNICIPALITY_ENVELOPE = "status string, data array<struct<id: string, name: string>>"


def seed_missing(seed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key the table does not hold yet; append these to the table."""
    return seed.join(existing.select(key), key, "left_anti")


def json_long(c: Column, member: str, default: int | None = None) -> Column:
    """A whole-number member of a JSON text column, with a default where it is absent."""
    value = F.get_json_object(c, f"$.{member}").try_cast("bigint")
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


def json_map(c: Column) -> Column:
    """A flat JSON object as map<string,string>."""
    return F.from_json(c, "map<string,string>")


def envelope_rows(responses: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Rows of the ``data`` array of landed responses; a response without it yields none."""
    parsed = responses.withColumn("_b", F.from_json(F.col(body), schema))
    keep = [c for c in responses.columns if c != body]
    return parsed.select(*keep, F.explode("_b.data").alias("_r")).select(*keep, "_r.*")


def transactions(responses: DataFrame) -> DataFrame:
    """Typed transaction rows from responses(year, city, body)."""
    rows = envelope_rows(responses, TRANSACTION_ENVELOPE)
    # texts that are no numbers become null before the cast; a failing cast is slow
    price = first_group(F.col("TradePrice"), r"^(\d+)$").try_cast("bigint")
    area = first_group(F.col("Area"), r"^(\d+(?:\.\d+)?)$").try_cast("double")
    return rows.select(
        "year",
        "city",
        F.col("MunicipalityCode").alias("municipality_code"),
        F.col("DistrictName").alias("district_name"),
        F.col("Type").alias("property_type"),
        price.alias("trade_price"),
        F.coalesce(
            F.col("UnitPrice").try_cast("bigint"), F.floor(F.try_divide(price, F.nullif(area, F.lit(0.0)))).cast("bigint")
        ).alias("price_per_sqm"),
        area.alias("area_sqm"),
        first_group(F.col("BuildingYear"), r"(\d{4})").try_cast("int").alias("building_year"),
        F.col("Structure").alias("structure"),
        F.col("Period").alias("trade_quarter"),
    )


def municipalities(responses: DataFrame) -> DataFrame:
    """Municipality rows from responses(area, body)."""
    rows = envelope_rows(responses, MUNICIPALITY_ENVELOPE)
    return rows.select(
        F.col("id").alias("code"), F.col("area").alias("prefecture_code"), F.col("name").alias("name_ja")
    )


def read_envelopes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON files partitioned as year=/city= or area=, parsed with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def features(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses with ``features`` parsed; unreadable or empty bodies give a null array."""
    parsed = F.from_json(F.col(body), FEATURE_COLLECTION)
    return responses.withColumn("features", parsed["features"]).drop(body)


#: layer, zoom, column and row in the path of a tile
TILE_PATH = r"([A-Za-z_]+)/(\d+)/(\d+)/(\d+)\.[a-z]+$"


def tile_presence(files: DataFrame) -> DataFrame:
    """(layer, z, x, y, present) from a file listing with path and length.

    A tile exists when its file is not empty. Files of other layers are in ``unknown_tiles``.
    """
    return _tiles(files).where(F.col("layer").isin(TILE_LAYERS)).drop("path")


def unknown_tiles(files: DataFrame) -> DataFrame:
    """(path) of the files that belong to no known layer, for the quarantine."""
    return _tiles(files).where(~F.col("layer").isin(TILE_LAYERS)).select("path")


def _tiles(files: DataFrame) -> DataFrame:
    part = [F.regexp_extract("path", TILE_PATH, i) for i in range(1, 5)]
    return files.select(
        "path",
        part[0].alias("layer"),
        part[1].try_cast("int").alias("z"),
        part[2].try_cast("int").alias("x"),
        part[3].try_cast("int").alias("y"),
        (F.col("length") > 0).alias("present"),
    )


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile listing of a landing folder; pruning leaves the bytes unread. A file of an unknown layer is an error that names it."""
    return tile_presence(known_tiles(landed_files(spark, path)))


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a folder, for ``read_tiles`` or, where unknown layers go to the quarantine, ``tile_presence`` and ``unknown_tiles``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def known_tiles(files: DataFrame) -> DataFrame:
    """``files``, or an error where one belongs to no known layer."""
    fault = F.raise_error(F.concat(F.lit("unknown layer: "), F.col("path")))
    checked = F.when(F.regexp_extract("path", TILE_PATH, 1).isin(TILE_LAYERS), F.col("path")).otherwise(fault)
    return files.select(checked.alias("path"), "length")
