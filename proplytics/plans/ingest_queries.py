"""Queries: loading listings, quality gates and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.functions.numbers import price_per_sqm
from proplytics.operators import ingest, score
from proplytics.plans import twins as D
from proplytics.plans.registry import query
from proplytics.plans.twins import dim, over
from proplytics.sources.dimensions import dimension
from proplytics.sources.views import with_views

_MERGED = ["price", "land_area_sqm", "building_area_sqm", "year_built", "floors", "road_width_m", "rebuild_possible",
           "coverage_ratio", "floor_area_ratio"]
_TEXTS = ["floor_plan", "structure", "use_zone", "address", "prefecture"]


def _folds(order: str) -> str:
    out = [f"arg_max({c}, {order}) FILTER ({c} IS NOT NULL) AS {c}" for c in _MERGED]
    out += [f"arg_max({c}, {order}) FILTER ({c} <> '') AS {c}" for c in _TEXTS]
    out += [f"arg_max({c}, {order}) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS {c}" for c in ("latitude", "longitude")]
    return ",\n ".join(out)


_CODE = "regexp_matches(municipality, '^[0-9]+$')"
BATCH = f"""batch AS (SELECT source, source_id, {_folds('scraped_at')},
 arg_max(municipality, scraped_at) FILTER ({_CODE}) AS municipality_code, min(scraped_at) AS first_seen, max(scraped_at) AS scraped_at
 FROM feed_batch GROUP BY source, source_id),
by_address AS (SELECT address_ja, min(id) AS match_id FROM stored_properties WHERE address_ja NOT IN ('', 'Unknown') GROUP BY address_ja),
rows AS (SELECT b.*, l.property_id AS known_id, a.match_id,
  CASE WHEN b.address <> '' AND b.address <> 'Unknown' THEN b.address ELSE b.source || ':' || b.source_id END AS anchor
 FROM batch b LEFT JOIN stored_listings l ON l.source_id = b.source AND l.source_listing_id = b.source_id
 LEFT JOIN by_address a ON a.address_ja = b.address),
founders AS (SELECT anchor, arg_min(source || ':' || source_id, (first_seen, source, source_id)) AS founder_id FROM rows
 WHERE known_id IS NULL AND match_id IS NULL GROUP BY anchor),
resolved AS (SELECT r.*, coalesce(known_id, match_id, founder_id) AS property_id, known_id IS NOT NULL AS is_listed,
  known_id IS NULL AND match_id IS NULL AND founder_id = source || ':' || source_id AS is_new
 FROM rows r LEFT JOIN founders f ON f.anchor = r.anchor)"""

UPDATES = f"""updates AS (SELECT property_id AS id, {_folds('(scraped_at, source, source_id)')},
 arg_max(municipality_code, (scraped_at, source, source_id)) FILTER (municipality_code IS NOT NULL) AS municipality_code,
 bool_or(is_new) AS founded, bool_or(NOT is_listed) AS attached FROM resolved GROUP BY property_id)"""


def _loaded(sql: str, extra: str = "") -> str:
    tables = BATCH + (",\n" + extra if extra else "")
    return with_views("feed_batch", "stored_properties", "stored_listings", extra=tables) + sql


def as_of():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def feed(s):
    return s.feed_batch.drop("seen", "k").withColumns(
        {"image_urls": F.array(F.concat("source_url", F.lit("/0.jpg")), F.concat("source_url", F.lit("/1.jpg"))),
         "raw_data": F.create_map(F.lit("title"), F.col("title"))}
    )


def stored_listings(s):
    empty = [F.lit(None).cast("map<string,string>").alias("raw_data_json"), F.lit(None).cast("timestamp_ntz").alias("delisted_at")]
    return s.stored_listings.select("*", *empty)


def resolved(s):
    return ingest.resolve_by_address(ingest.fold_listings(feed(s)), stored_listings(s), s.stored_properties)


@query(
    "win08_last_write",
    over("listing_feed", sql="""SELECT source, source_id, arg_max(price_text, (scraped_at, l_partkey, l_suppkey, price_text)) AS price_text,
 max(scraped_at) AS scraped_at FROM listing_feed GROUP BY source, source_id"""),
)
def _last(s):
    rows = ingest.last_write(s.listing_feed, ["source", "source_id"], ["scraped_at", "l_partkey", "l_suppkey", "price_text"])
    return rows.select("source", "source_id", "price_text", "scraped_at")


@query(
    "ups03_fold_listings",
    _loaded(f"SELECT source, source_id, {', '.join(_MERGED + _TEXTS)}, latitude, longitude, municipality_code FROM batch"),
)
def _fold(s):
    return ingest.fold_listings(feed(s)).select(
        "source", "source_id", *_MERGED, *_TEXTS, "latitude", "longitude", "municipality_code"
    )


@query(
    "jn01_known_listing",
    over("listing_feed", "stored_listings", sql="""SELECT f.source, f.source_id, f.l_partkey, l.property_id AS known_id FROM listing_feed f
 LEFT JOIN stored_listings l ON l.source_id = f.source AND replace(l.source_listing_id, 'F', '') || '-1' = f.source_id"""),
)
def _known(s):
    stored = s.stored_listings.withColumn("source_listing_id", F.concat(F.replace("source_listing_id", F.lit("F"), F.lit("")), F.lit("-1")))
    return ingest.with_known(s.listing_feed.select("source", "source_id", "l_partkey"), stored)


@query("ups01_outcomes", _loaded("SELECT source, source_id, property_id, is_new FROM resolved"))
def _outcomes(s):
    return resolved(s).select("source", "source_id", "property_id", "is_new")


_PICK = ", ".join(
    f"coalesce(u.{c}, s.{p}) AS {p}"
    for c, p in [(c, ingest.RENAMED.get(c, c)) for c in _MERGED + _TEXTS + ["latitude", "longitude", "municipality_code"]]
    if c not in ("price", "address")
)


@query(
    "ups01_properties",
    _loaded(f"""SELECT id, address_ja, price_jpy, {', '.join(ingest.RENAMED.get(c, c) for c in _MERGED + _TEXTS + ['latitude', 'longitude', 'municipality_code'] if c not in ('price', 'address'))},
 CASE WHEN attached AND price_jpy <> 0 AND land_area_sqm > 0 THEN price_jpy / land_area_sqm ELSE price_per_sqm END AS price_per_sqm, status FROM (
 SELECT coalesce(s.id, u.id) AS id, coalesce(u.address, s.address_ja, 'Unknown') AS address_ja, coalesce(u.price, s.price_jpy, 0) AS price_jpy, {_PICK},
  u.attached, s.price_per_sqm, 'active' AS status FROM stored_properties s FULL JOIN updates u ON u.id = s.id)""", UPDATES),
)
def _properties(s):
    from proplytics.session import materialise

    updates = materialise(ingest.fold_updates(resolved(s)))
    return ingest.merge_properties(s.stored_properties, updates, as_of())


@query(
    "ups01_listings",
    _loaded("""SELECT l.property_id, l.source_id, l.source_listing_id, 'https://portal.example/old' AS source_url, 'active' AS listing_status,
 l.first_scraped_at, r.scraped_at AS last_scraped_at, '物件 ' || l.source_listing_id AS title FROM stored_listings l JOIN resolved r ON r.source = l.source_id AND r.source_id = l.source_listing_id
UNION ALL SELECT property_id, source, source_id, 'https://portal.example/' || source_id, 'active', first_seen, scraped_at, '物件 ' || source_id FROM resolved WHERE NOT is_listed"""),
)
def _listings(s):
    rows = ingest.merge_listings(stored_listings(s), resolved(s))
    return rows.select(
        "property_id", "source_id", "source_listing_id", "source_url", "listing_status", "first_scraped_at", "last_scraped_at",
        F.try_element_at("raw_data_json", F.lit("title")).alias("title"),
    )


@query(
    "ups02_tiered_upsert",
)
def _tiered(s):
    """Upsert with the three matching tiers; checked against brute force in the tests."""
    incoming = s.incoming.select(
        F.lit("homes").alias("source"), F.col("key").cast("string").alias("source_id"), "address", "municipality",
        F.col("lat").alias("latitude"), F.col("lng").alias("longitude"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("first_seen"),
    )
    from proplytics.operators.match import with_normalized
    from proplytics.session import materialise

    stored = materialise(with_normalized(s.properties.select(F.col("id").cast("string").alias("id"), "address_ja", "lat", "lng")))
    rows = ingest.resolve_by_tiers(incoming, stored_listings(s), stored)
    return rows.select("source", "source_id", "property_id", "is_new")


@query(
    "ups04_defaults",
    _loaded("""SELECT r.property_id, coalesce(u.address, 'Unknown') AS address_ja, coalesce(u.price, 0) AS price_jpy, 'active' AS status
FROM resolved r JOIN updates u ON u.id = r.property_id WHERE r.is_new""", UPDATES),
)
def _defaults(s):
    rows = resolved(s)
    merged = ingest.merge_properties(s.stored_properties, ingest.fold_updates(rows), as_of())
    fresh = rows.where("is_new").select(F.col("property_id").alias("id"))
    return merged.join(fresh, "id").select(F.col("id").alias("property_id"), "address_ja", "price_jpy", "status")


@query(
    "ups04_hazard_stubs",
    _loaded("SELECT property_id, TIMESTAMP '2026-01-01 00:00:00' AS assessed_at FROM resolved WHERE is_new"),
)
def _stubs(s):
    """The empty hazard row that every new property gets."""
    return ingest.upsert(feed(s), stored_listings(s), s.stored_properties, as_of()).hazards


@query(
    "win05_image_ordinal",
    _loaded("""SELECT property_id, 'https://portal.example/' || source_id || '/' || n || '.jpg' AS storage_path, n AS sort_order,
 'Property image ' || (n + 1) AS alt_text, CASE n WHEN 0 THEN 'exterior' ELSE 'interior' END AS image_type
FROM resolved CROSS JOIN (SELECT unnest([0, 1]) AS n) WHERE NOT is_listed"""),
)
def _images(s):
    return ingest.image_rows(resolved(s))


@query(
    "agg10_run_summary",
    _loaded("""SELECT count(*) AS listings_found, count(*) FILTER (is_new) AS listings_new, count(*) FILTER (NOT is_new) AS listings_updated,
 CAST(0 AS BIGINT) AS errors FROM resolved"""),
)
def _summary(s):
    return ingest.run_summary(resolved(s))


@query(
    "ups06_score_upsert",
    D.over("properties", "hazard_assessments", extra=D.SCORES + """,
old AS (SELECT o_orderkey AS property_id, CASE WHEN o_orderkey % 2 = 0 THEN '1.0' ELSE '0.9' END AS scoring_version, 1.5::DOUBLE AS composite_score FROM orders)""",
           sql="""SELECT property_id, scoring_version, composite_score FROM scores UNION ALL SELECT property_id, scoring_version, composite_score FROM old WHERE scoring_version <> '1.0'"""),
)
def _score_upsert(s):
    version = F.when(F.col("o_orderkey") % 2 == 0, "1.0").otherwise("0.9")
    old = s.orders.select(F.col("o_orderkey").alias("property_id"), version.alias("scoring_version"), F.lit(1.5).alias("composite_score"))
    return ingest.upsert_scores(old, score.score_properties(s.properties, s.hazard_assessments))


@query(
    "ups06_denormalised_score",
    D.scored("SELECT id, composite_score FROM scored"),
)
def _denormalised(s):
    scores = score.score_properties(s.properties, s.hazard_assessments)
    blank = s.properties.select("id", F.lit(None).cast("double").alias("composite_score"))
    return ingest.denormalise_scores(blank, scores)


@query(
    "ups10_duplicate_listings",
    over("listing_feed", sql="SELECT source, source_id, count(*) AS n FROM listing_feed GROUP BY source, source_id HAVING count(*) > 1"),
)
def _duplicates(s):
    return ingest.duplicate_keys(s.listing_feed, ["source", "source_id"])


@query(
    "ups10_dangling_prefecture",
    f"""WITH {dim('prefectures')} SELECT key, code FROM (SELECT c_custkey AS key, lpad(CAST(c_custkey % 50 AS VARCHAR), 2, '0') AS code FROM customer)
WHERE code NOT IN (SELECT code FROM prefectures)""",
)
def _dangling(s):
    rows = s.customer.select(F.col("c_custkey").alias("key"), F.lpad((F.col("c_custkey") % 50).cast("string"), 2, "0").alias("code"))
    return ingest.dangling(rows, "code", dimension(s.spark, "prefectures"), "code")


@query(
    "flt11_price_gate",
    over("listing_feed", sql=f"""SELECT source, source_id, l_partkey, l_suppkey, price FROM (SELECT *, {D.price_any('source', 'price_text')} AS price FROM listing_feed)
WHERE price IS NULL OR price = 0 OR price BETWEEN 1000000 AND 15000000"""),
)
def _price_gate(s):
    from proplytics.functions.text import parse_price

    rows = s.listing_feed.select("source", "source_id", "l_partkey", "l_suppkey", parse_price(F.col("source"), F.col("price_text")).alias("price"))
    return rows.where(ingest.price_gate(F.col("price"), 1_000_000, 15_000_000))


@query(
    "flt12_valid_listing",
    over("listing_feed", "properties", sql=f"""SELECT source, count(*) AS n, count(*) FILTER (CASE source
  WHEN 'akiya' THEN coalesce(address <> '', FALSE) OR price IS NOT NULL WHEN 'bit' THEN coalesce(address <> '', FALSE)
  ELSE coalesce(address <> '', FALSE) OR coalesce(price <> 0, FALSE) END) AS valid
FROM (SELECT source, {D.price_any('source', 'price_text')} AS price, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE '松本市' END AS address FROM listing_feed) GROUP BY source"""),
)
def _valid(s):
    from proplytics.functions.text import parse_price

    address = F.when(F.col("l_partkey") % 2 == 0, "").otherwise("松本市")
    none = F.lit(None).cast("string")
    ok = ingest.valid_listing(F.col("source"), address, parse_price(F.col("source"), F.col("price_text")), none, none)
    return s.listing_feed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


_FAULT = """CASE WHEN source NOT IN ('suumo','homes','athome','akiya','bit') THEN 'unknown source' WHEN source_id = '' THEN 'no source id'
 WHEN price < 0 THEN 'negative price' WHEN length(prefecture) > 2 THEN 'prefecture is not a code' END"""
_DIRTY = """SELECT CASE l_suppkey % 17 WHEN 0 THEN 'other' ELSE 'homes' END AS source, CASE l_partkey % 13 WHEN 0 THEN '' ELSE concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS source_id,
 CAST(l_partkey AS BIGINT) - 20 AS price, CASE l_suppkey % 11 WHEN 0 THEN '長野県' ELSE '20' END AS prefecture FROM lineitem"""


def _dirty(s):
    from proplytics.sources.views import bind

    return bind(s.spark, _DIRTY, lineitem=s.lineitem)


@query("snk05_quarantine", f"SELECT * FROM (SELECT *, {_FAULT} AS fault FROM ({_DIRTY})) WHERE fault IS NOT NULL")
def _quarantine(s):
    return ingest.split_valid(_dirty(s))[1]


@query(
    "snk05_error_message",
    f"""SELECT string_agg(line, '; ' ORDER BY source, source_id, line) AS error_message FROM (SELECT source, source_id, concat('Upsert failed: ', source_id, ': ', fault) AS line
FROM (SELECT *, {_FAULT} AS fault FROM ({_DIRTY})) WHERE fault IS NOT NULL ORDER BY source, source_id, line LIMIT 5)""",
)
def _message(s):
    return ingest.error_message(ingest.split_valid(_dirty(s))[1])


@query(
    "set01_union_portals",
    "SELECT source, kind, count(*) AS n FROM (SELECT 'homes' AS source, l_linestatus AS kind FROM lineitem UNION ALL SELECT 'bit', o_orderstatus FROM orders UNION ALL SELECT 'akiya', NULL FROM customer) GROUP BY source, kind",
)
def _union(s):
    frames = [
        s.lineitem.select(F.lit("homes").alias("source"), F.col("l_linestatus").alias("kind")),
        s.orders.select(F.col("o_orderstatus").alias("kind"), F.lit("bit").alias("source")),
        s.customer.select(F.lit("akiya").alias("source")),
    ]
    return ingest.union_portals(frames).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))
