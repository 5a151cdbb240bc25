"""Queries: table scans, filters, market statistics, search and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.operators import market, score, search
from proplytics.operators.search import Filters
from proplytics.plans.registry import Source, query
from proplytics.plans.twins import dim, over, scored
from proplytics.sources import dimensions
from proplytics.sources.dimensions import dimension


def scored_properties(s: Source):
    """Properties with their composite score."""
    return score.with_scores(s.properties, s.hazard_assessments).select(*s.properties.columns, "composite_score")


# --- scans and seeds --------------------------------------------------------

BASIC = "id, address_ja, prefecture_code, price_jpy, land_area_sqm, year_built, status, created_at"
BASIC_COLUMNS = BASIC.split(", ")


@query("src01_table_scan", over("properties", sql=f"SELECT {BASIC} FROM properties"))
def _scan(s):
    return s.properties.select(*BASIC_COLUMNS)


@query(
    "src02_seed_prefectures",
    f"""WITH {dim('prefectures')}, present AS (
 SELECT DISTINCT lpad(CAST(c_nationkey % 47 + 1 AS VARCHAR), 2, '0') AS code FROM customer)
SELECT code, name_ja, name_en, region FROM prefectures WHERE code NOT IN (SELECT code FROM present)""",
)
def _seed(s):
    from proplytics.sources.feeds import seed_missing

    present = s.customer.select(
        F.lpad((F.col("c_nationkey") % 47 + 1).cast("string"), 2, "0").alias("code")
    ).distinct()
    return seed_missing(dimension(s.spark, "prefectures"), present, "code")


@query(
    "src07_json_column",
    """SELECT event_id, coalesce(TRY_CAST(props::JSON->>'$.price_max' AS BIGINT), 15000000) AS price_max,
 TRY_CAST(props::JSON->>'$.k' AS BIGINT) AS k FROM events""",
)
def _json(s):
    from proplytics.sources.feeds import json_long

    return s.events.select(
        "event_id",
        json_long(F.col("props"), "price_max", 15_000_000).alias("price_max"),
        json_long(F.col("props"), "k").alias("k"),
    )


# --- filters ----------------------------------------------------------------


def _filter(name: str, where: str, filters: Filters, on_scored: bool = False):
    sql = f"SELECT id, price_jpy, status FROM {'scored' if on_scored else 'properties'} WHERE {where}"
    twin = scored(sql) if on_scored else over("properties", sql=sql)

    @query(name, twin)
    def run(s):
        base = scored_properties(s) if on_scored else s.properties
        return search.find(base, filters).select("id", "price_jpy", "status")


_filter("flt01_status", "status = 'active'", Filters())
_filter("flt02_price_range", "status = 'active' AND price_jpy >= 1000000 AND price_jpy <= 8000000",
        Filters(price_min=1_000_000, price_max=8_000_000))
_filter("flt03_codes", "status = 'active' AND prefecture_code = '13'", Filters(prefecture_code="13"))
_filter("flt03_municipality", "status = 'active' AND municipality_code = '13101'", Filters(municipality_code="13101"))
_filter("flt04_min_score", "status = 'active' AND composite_score >= 60", Filters(min_score=60.0), on_scored=True)
_filter("flt05_rebuild", "status = 'active' AND rebuild_possible = TRUE", Filters(rebuild_possible=True))
_filter("flt06_substring", "status = 'active' AND address_ja ILIKE '%コーポ a%'", Filters(search="コーポ a"))
_filter("flt07_located", "status = 'active' AND lat IS NOT NULL AND lng IS NOT NULL", Filters(located=True))


@query(
    "flt08_needs_geocoding",
    over("properties", sql="""SELECT count(*) AS pending, least(500, count(*)) AS batch_size
FROM properties WHERE lat IS NULL AND address_ja IS NOT NULL"""),
)
def _needs_geocoding(s):
    from proplytics.operators.enrich import pending_geocoding

    return pending_geocoding(s.properties, limit=500)


@query(
    "flt09_unknown_address",
    over("properties", sql="""SELECT count(*) FILTER (address_ja = 'Unknown' OR address_ja IS NULL) AS unknown,
 count(*) FILTER (address_ja <> 'Unknown' AND lat IS NULL) AS known_ungeocoded
FROM (SELECT nullif(address_ja, '東京都新宿区西新宿 1-1-1') AS address_ja, lat FROM properties)"""),
)
def _unknown(s):
    from proplytics.operators.enrich import address_quality

    p = s.properties.select(F.nullif(F.col("address_ja"), F.lit("東京都新宿区西新宿 1-1-1")).alias("address_ja"), "lat")
    return address_quality(p)


@query(
    "flt09_ungeocoded_sample",
    over("properties", sql="""SELECT id, address_ja FROM properties WHERE lat IS NULL AND address_ja IS NOT NULL
 AND address_ja <> 'Unknown' ORDER BY id LIMIT 5"""),
)
def _sample(s):
    from proplytics.operators.enrich import ungeocoded_sample

    return ungeocoded_sample(s.properties, 5).select("id", "address_ja")


@query("flt10_control_space", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[\\n\\r\\t]')")
def _control(s):
    from proplytics.functions.text import has_control_space

    return s.documents.where(has_control_space(F.col("text"))).select("doc_id")


@query(
    "flt17_transactions",
    over("transactions", sql="""SELECT id, municipality_code, property_type, trade_price, created_at FROM transactions
WHERE municipality_code = '02102' AND property_type = 'land' ORDER BY created_at DESC NULLS FIRST, id LIMIT 100"""),
)
def _transactions(s):
    return market.recent_transactions(s.transactions, 100, "02102", "land").select(
        "id", "municipality_code", "property_type", "trade_price", "created_at"
    )


@query(
    "flt20_key_lookup",
    over("properties", sql="""SELECT k.id, p.address_ja, p.price_jpy, p.id IS NOT NULL AS found
FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) k LEFT JOIN properties p ON p.id = k.id"""),
)
def _lookup(s):
    keys = s.lineitem.select(F.col("l_partkey").alias("id")).distinct()
    return search.lookup(keys, s.properties.select("id", "address_ja", "price_jpy"))


# --- sort and pages ---------------------------------------------------------


@query(
    "srt01_sort_by_column",
    over("properties", sql="SELECT id, land_area_sqm FROM properties ORDER BY land_area_sqm DESC NULLS FIRST, id"),
)
def _sorted(s):
    return search.ordered(s.properties, "land_area_sqm").select("id", "land_area_sqm")


@query(
    "srt01_unknown_column",
    over("properties", sql="SELECT id, created_at FROM properties ORDER BY created_at ASC NULLS LAST, id"),
)
def _sorted_unknown(s):
    return search.ordered(s.properties, "no_such", descending=False).select("id", "created_at")


@query(
    "srt02_page",
    scored("""SELECT id, price_jpy, composite_score FROM scored WHERE status = 'active'
ORDER BY composite_score DESC NULLS FIRST, id LIMIT 50 OFFSET 100"""),
)
def _page(s):
    rows = search.find(scored_properties(s), Filters())
    return search.page(rows, 3, 50, sort_by="composite_score").select("id", "price_jpy", "composite_score")


@query(
    "srt03_newest",
    over("scrape_jobs", sql="SELECT id, source_id, status, created_at FROM scrape_jobs ORDER BY created_at DESC, id LIMIT 50"),
)
def _newest(s):
    return search.newest(s.scrape_jobs, 50).select("id", "source_id", "status", "created_at")


@query(
    "srt04_by_code",
    f"""WITH {dim('prefectures')} SELECT p.code, p.name_en, count(o.o_orderkey) AS n FROM prefectures p
LEFT JOIN orders o ON lpad(CAST(o.o_custkey % 47 + 1 AS VARCHAR), 2, '0') = p.code GROUP BY p.code, p.name_en ORDER BY p.code""",
)
def _by_code(s):
    counts = s.properties.groupBy(F.col("prefecture_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return (
        dimension(s.spark, "prefectures")
        .join(counts, "code", "left")
        .select("code", "name_en", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
        .orderBy("code")
    )


@query(
    "srt05_batch_by_id",
    over("properties", sql="SELECT id, address_ja FROM properties WHERE lat IS NULL AND address_ja IS NOT NULL ORDER BY id LIMIT 100"),
)
def _batch(s):
    from proplytics.operators.enrich import geocoding_batch

    return geocoding_batch(s.properties, 100).select("id", "address_ja")


# --- aggregates -------------------------------------------------------------


@query(
    "agg01_market_stats",
    scored("""SELECT count(*) AS total_properties, count(*) FILTER (status = 'active') AS active_properties,
 CAST(round_even(avg(price_jpy) FILTER (status = 'active'), 0) AS BIGINT) AS avg_price,
 format('{:.1f}', (CAST(sum(round(composite_score * 100)) AS BIGINT)::DOUBLE / count(composite_score) / 100))::DOUBLE AS avg_score,
 count(*) FILTER (status = 'active' AND rebuild_possible) AS rebuild_ok,
 count(*) FILTER (status = 'active' AND NOT rebuild_possible) AS rebuild_ng,
 count(*) FILTER (status = 'active' AND rebuild_possible IS NULL) AS rebuild_unknown FROM scored"""),
)
def _market(s):
    return market.market_stats(scored_properties(s))


HISTOGRAM = """SELECT b.label, b.lo AS "min", b.hi AS "max", count(p.id) AS "count" FROM price_buckets b
 LEFT JOIN properties p ON p.price_jpy >= b.lo AND p.price_jpy < b.hi AND p.status = 'active'
 GROUP BY b.label, b.lo, b.hi"""


@query("agg03_price_histogram", over("properties", extra=dim("price_buckets"), sql=HISTOGRAM))
def _histogram(s):
    return market.price_histogram(s.properties)


@query(
    "agg16_histogram_bars",
    over("properties", extra=dim("price_buckets"), sql=f"""SELECT label, "min", "max", "count",
 greatest(2.0::DOUBLE, "count"::DOUBLE / greatest(max("count") OVER (), 1) * 100) AS width_pct FROM ({HISTOGRAM})"""),
)
def _bars(s):
    return market.histogram_bars(market.price_histogram(s.properties))


@query(
    "agg05_municipality_stats",
    scored("""SELECT municipality_code, count(*) FILTER (status = 'active') AS property_count,
 CAST(round_even(coalesce(avg(price_jpy) FILTER (status = 'active'), 0), 0) AS BIGINT) AS avg_price,
 nullif(format('{:.1f}', (CAST(sum(round(composite_score * 100)) AS BIGINT)::DOUBLE / count(composite_score) / 100))::DOUBLE, 0) AS avg_score FROM scored GROUP BY municipality_code"""),
)
def _municipality(s):
    return market.municipality_stats(scored_properties(s))


@query(
    "agg06_coverage_by_source",
    over("properties", "listing_feed", sql="""SELECT l.source, count(*) AS total, count(p.lat) AS has_coords,
 count(*) - count(p.lat) AS missing_coords FROM properties p JOIN listing_feed l ON l.property_id = p.id
 WHERE p.status = 'active' GROUP BY l.source"""),
)
def _coverage(s):
    return market.coverage_by_source(s.properties, s.listing_feed)


@query(
    "agg07_page_count",
    over("properties", sql="""SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages
FROM properties WHERE status = 'active' AND price_jpy <= 5000000"""),
)
def _pages(s):
    return search.page_count(search.find(s.properties, Filters(price_max=5_000_000)))


@query(
    "agg15_rebuild_shares",
    over("properties", sql="""SELECT n AS active_properties, CAST(floor(ok::DOUBLE / n * 100 + 0.5) AS BIGINT) AS ok_pct,
 CAST(floor(ng::DOUBLE / n * 100 + 0.5) AS BIGINT) AS ng_pct, CAST(floor((n - ok - ng)::DOUBLE / n * 100 + 0.5) AS BIGINT) AS unknown_pct
FROM (SELECT count(*) AS n, count(*) FILTER (rebuild_possible) AS ok, count(*) FILTER (NOT rebuild_possible) AS ng
 FROM properties WHERE status = 'active')"""),
)
def _shares(s):
    return market.rebuild_shares(s.properties)


@query(
    "agg21_page_averages",
    scored("""SELECT CAST(floor((CAST(sum(round(composite_score * 100)) AS BIGINT)::DOUBLE / count(composite_score) / 100) + 0.5) AS BIGINT) AS avg_score,
 CAST(floor(avg(price_jpy) + 0.5) AS BIGINT) AS avg_price, count(*) FILTER (status = 'active') AS active_count
FROM (SELECT * FROM scored ORDER BY created_at DESC NULLS FIRST, id LIMIT 200)"""),
)
def _page_averages(s):
    return market.page_averages(search.page(scored_properties(s), 1, 200))


@query(
    "agg22_map_extent",
    over("properties", sql="SELECT min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat FROM properties"),
)
def _extent(s):
    return market.map_extent(s.properties)


@query(
    "agg23_map_clusters",
    over("properties", sql="""SELECT cell, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng,
 CASE WHEN count(*) = 1 THEN 'point' WHEN count(*) < 10 THEN 'small' WHEN count(*) < 50 THEN 'medium'
  WHEN count(*) < 200 THEN 'large' ELSE 'huge' END AS step
FROM (SELECT lat, lng, concat('6/', CAST(trunc((lng + 180) / 360 * 512) AS INT), '/',
  CAST(trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512) AS INT)) AS cell
 FROM properties WHERE lat IS NOT NULL AND lng IS NOT NULL) GROUP BY cell"""),
)
def _clusters(s):
    return market.map_clusters(s.properties, 6).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


# --- sinks and projections --------------------------------------------------

_NUM = "CASE WHEN {c} <> 0 THEN {c}::VARCHAR ELSE '' END AS {n}"


def _csv(cols: list[tuple[str, str]]) -> str:
    return ", ".join(_NUM.format(c=c, n=n) for c, n in cols)


@query(
    "snk01_csv_properties",
    scored(f"""SELECT id::VARCHAR AS id, address_ja AS address, price_jpy::VARCHAR AS price,
 {_csv([('land_area_sqm', 'land_area_sqm'), ('year_built', 'year_built'), ('road_width_m', 'road_width_m'),
        ('composite_score', 'composite_score'), ('lat', 'latitude'), ('lng', 'longitude')])},
 '' AS building_area_sqm, coalesce(floor_plan, '') AS floor_plan, coalesce(structure, '') AS structure,
 CASE rebuild_possible WHEN TRUE THEN 'true' WHEN FALSE THEN 'false' ELSE '' END AS rebuild_possible,
 '' AS city_planning_zone, coalesce(use_zone, '') AS use_zone, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
FROM (SELECT * FROM scored WHERE status = 'active' AND price_jpy >= 500000 ORDER BY created_at DESC NULLS FIRST, id)"""),
)
def _csv_properties(s):
    return search.export_properties(scored_properties(s), Filters(price_min=500_000))


@query(
    "snk02_csv_deals",
    over("deals", sql=f"""SELECT id::VARCHAR AS id, property_id::VARCHAR AS property_id, stage,
 {_csv([('purchase_price', 'purchase_price'), ('renovation_budget', 'renovation_budget'),
        ('target_sale_price', 'target_sale_price')])},
 '' AS notes, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, '' AS updated_at FROM deals"""),
)
def _csv_deals(s):
    return search.export_deals(s.deals)


@query("snk03_geojson")
def _geojson(s):
    """One Feature per row; checked member by member in snk03_geojson_members."""
    return search.geojson_features(search.find(scored_properties(s), Filters(located=True)))


@query(
    "snk03_geojson_members",
    scored("""SELECT id, 'Feature' AS type, 'Point' AS geometry, lng, lat, price_jpy AS price,
 nullif(composite_score, 0) AS score, floor_plan, rebuild_possible FROM scored
WHERE status = 'active' AND lat IS NOT NULL AND lng IS NOT NULL"""),
)
def _geojson_members(s):
    features = search.geojson_features(search.find(scored_properties(s), Filters(located=True)))
    schema = (
        "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<price: bigint, "
        "score: double, floor_plan: string, rebuild_possible: boolean>"
    )
    f = features.select("id", F.from_json("feature", schema).alias("f"))
    return f.select(
        "id", "f.type", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates")[0].alias("lng"),
        F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*",
    )


@query(
    "snk04_record",
    scored("""SELECT id::VARCHAR AS id, address_ja, prefecture_code, municipality_code, lat AS latitude, lng AS longitude,
 price_jpy AS price, nullif(land_area_sqm, 0) AS land_area_sqm, year_built, structure, floor_plan, nullif(road_width_m, 0) AS road_width_m,
 road_frontage_m, rebuild_possible, use_zone, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
 nullif(composite_score, 0) AS composite_score FROM scored"""),
)
def _record(s):
    return search.record(scored_properties(s))


@query(
    "jn07_property_listings",
    over("properties", "listing_feed", sql="""SELECT p.id, p.price_jpy, l.source, l.source_id, l.scraped_at
FROM properties p LEFT JOIN listing_feed l ON l.property_id = p.id"""),
)
def _with_listings(s):
    rows = search.with_listings(
        s.properties.select("id", "price_jpy"), s.listing_feed.select("property_id", "source", "source_id", "scraped_at")
    )
    return rows


@query(
    "jn07_listing_summary",
    over("properties", "listing_feed", sql="""SELECT p.id, coalesce(l.n, 0) AS n_listings, l.last_scraped_at
FROM properties p LEFT JOIN (SELECT property_id, count(*) AS n, max(scraped_at) AS last_scraped_at FROM listing_feed GROUP BY property_id) l
ON l.property_id = p.id"""),
)
def _listing_summary(s):
    return search.listing_summary(s.properties.select("id"), s.listing_feed)


@query(
    "jn08_inner_join",
    over("properties", "listing_feed", sql="""SELECT p.id, p.status, l.source, l.source_id, l.price_text
FROM properties p JOIN listing_feed l ON l.property_id = p.id WHERE p.status = 'active'"""),
)
def _inner(s):
    p = s.properties.where("status = 'active'").select("id", "status")
    l = s.listing_feed.select("property_id", "source", "source_id", "price_text")
    return p.join(l, p["id"] == l["property_id"]).drop("property_id")


@query(
    "agg02_average_price",
    over("properties", sql="SELECT CAST(round_even(avg(price_jpy), 0) AS BIGINT) AS avg_price FROM properties WHERE status = 'active' AND price_jpy IS NOT NULL"),
)
def _average(s):
    return market.market_stats(s.properties.withColumn("composite_score", F.lit(None).cast("double"))).select("avg_price")


@query(
    "agg04_tri_state",
    over("properties", sql="""SELECT count(*) FILTER (rebuild_possible) AS rebuild_ok, count(*) FILTER (NOT rebuild_possible) AS rebuild_ng,
 count(*) FILTER (rebuild_possible IS NULL) AS rebuild_unknown FROM properties WHERE status = 'active'"""),
)
def _tri_state(s):
    stats = market.market_stats(s.properties.withColumn("composite_score", F.lit(None).cast("double")))
    return stats.select("rebuild_ok", "rebuild_ng", "rebuild_unknown")
