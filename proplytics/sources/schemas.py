"""Explicit schemas: scans never infer, and file footers are not read for planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Landed generic tables
BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Property domain
LISTING = (
    "source string, source_id string, source_url string, title string, price bigint, address string, "
    "prefecture string, municipality string, land_area_sqm double, building_area_sqm double, floor_plan string, "
    "year_built int, structure string, floors int, road_width_m double, road_frontage_m double, "
    "rebuild_possible boolean, city_planning_zone string, use_zone string, coverage_ratio double, "
    "floor_area_ratio double, latitude double, longitude double, image_urls array<string>, "
    "raw_data map<string,string>, scraped_at timestamp_ntz"
)
PROPERTIES = (
    "id string, address_ja string, address_normalized string, address_en string, prefecture_code string, "
    "municipality_code string, lat double, lng double, price_jpy bigint, land_area_sqm double, "
    "building_area_sqm double, floor_plan string, year_built int, structure string, floors int, road_width_m double, "
    "road_frontage_m double, rebuild_possible boolean, city_planning_zone string, use_zone string, "
    "coverage_ratio double, floor_area_ratio double, price_per_sqm double, composite_score double, "
    "description_ja string, description_en string, status string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, last_seen_at timestamp_ntz"
)
PROPERTY_LISTINGS = (
    "property_id string, source_id string, source_listing_id string, source_url string, "
    "raw_data_json map<string,string>, listing_status string, first_scraped_at timestamp_ntz, "
    "last_scraped_at timestamp_ntz, delisted_at timestamp_ntz"
)
PROPERTY_IMAGES = ("property_id string, storage_path string, sort_order int, alt_text string, image_type string")
HAZARD_ASSESSMENTS = (
    "property_id string, mesh_code string, seismic_intensity_prob map<string,double>, pga_475yr double, "
    "liquefaction_risk string, flood_depth_max_m double, flood_zone string, tsunami_risk string, "
    "tsunami_depth_max_m double, landslide_risk string, steep_slope_zone boolean, "
    "landslide_prevention_zone boolean, data_sources map<string,string>, assessed_at timestamp_ntz"
)
PROPERTY_SCORES = (
    "property_id string, scoring_version string, rebuild_score double, hazard_score double, "
    "infrastructure_score double, demographic_score double, value_score double, condition_score double, "
    "composite_score double, weights map<string,double>, scored_at timestamp_ntz"
)
DEALS = (
    "id string, property_id string, stage string, purchase_price bigint, purchase_date date, "
    "renovation_budget bigint, target_sale_price bigint, holding_period_months int, notes string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
DUE_DILIGENCE_ITEMS = (
    "id string, deal_id string, category string, item_name string, description string, is_completed boolean, "
    "completed_at timestamp_ntz, due_date date, notes string, sort_order int"
)
SCRAPE_JOBS = (
    "id string, source_id string, prefecture_code string, municipality_code string, search_params string, "
    "status string, started_at timestamp_ntz, completed_at timestamp_ntz, listings_found int, listings_new int, "
    "listings_updated int, error_message string, created_at timestamp_ntz"
)
SCRAPE_LOGS = (
    "id bigint, job_id string, level string, message string, url string, response_status int, created_at timestamp_ntz"
)
POPULATION_MESH = (
    "mesh_code string, bbox_min_lat double, bbox_min_lng double, bbox_max_lat double, bbox_max_lng double, "
    "municipality_code string, population_current int, population_2030 int, population_2040 int, "
    "population_2050 int, households_current int, elderly_ratio decimal(5,2)"
)
TRANSACTION_HISTORY = (
    "id string, municipality_code string, district_name string, property_type string, trade_price bigint, "
    "price_per_sqm bigint, area_sqm decimal(10,2), building_year int, structure string, trade_quarter string, "
    "created_at timestamp_ntz"
)


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE[name]).parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Table scan with a declared schema."""
    return spark.read.schema(schema).parquet(path)
