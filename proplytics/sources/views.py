"""Property-domain views over the landed tables.

Each view is one SELECT that Spark SQL and DuckDB read alike; ``view`` binds it to
DataFrames, ``with_views`` renders it as a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proplytics.sources.schemas import BASE, base_table

VIEWS: dict[str, str] = {}

VIEWS["properties"] = """
SELECT o_orderkey AS id,
 concat(CASE o_custkey % 6 WHEN 0 THEN '東京都新宿区西新宿' WHEN 1 THEN '大阪府大阪市北区梅田' WHEN 2 THEN '北海道札幌市中央区大通西' WHEN 3 THEN '長野県松本市中央' WHEN 4 THEN '京都府京都市中京区' ELSE '山形県山形市七日町' END,
  CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_custkey % 9 + 1 AS STRING),'丁目',CAST(o_custkey % 20 + 1 AS STRING),'番',CAST(o_custkey % 15 + 1 AS STRING),'号')
   WHEN 1 THEN concat(CAST(o_custkey % 9 + 1 AS STRING),'丁目',CAST(o_custkey % 20 + 1 AS STRING),'番地',CAST(o_custkey % 15 + 1 AS STRING),'号 コーポ A')
   WHEN 2 THEN concat(CAST(o_custkey % 9 + 1 AS STRING),'ー',CAST(o_custkey % 20 + 1 AS STRING),'ー',CAST(o_custkey % 15 + 1 AS STRING))
   ELSE concat(' ',CAST(o_custkey % 9 + 1 AS STRING),'-',CAST(o_custkey % 20 + 1 AS STRING),'-',CAST(o_custkey % 15 + 1 AS STRING)) END) AS address_ja,
 lpad(CAST(o_custkey % 47 + 1 AS STRING),2,'0') AS prefecture_code,
 concat(lpad(CAST(o_custkey % 47 + 1 AS STRING),2,'0'), CAST(101 + o_custkey % 12 AS STRING)) AS municipality_code,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(30 AS DOUBLE) + CAST(o_custkey * 7919 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) + CAST(o_orderkey % 3 AS DOUBLE) * CAST(0.0002 AS DOUBLE) END AS lat,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(130 AS DOUBLE) + CAST(o_custkey * 6007 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) END AS lng,
 CAST(floor(o_totalprice * CAST(60 AS DOUBLE)) AS BIGINT) AS price_jpy,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(30 AS DOUBLE) + CAST(o_orderkey * 37 % 4700 AS DOUBLE)/CAST(10 AS DOUBLE) END AS land_area_sqm,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(1948 + o_orderkey * 13 % 78 AS INT) END AS year_built,
 CASE o_custkey % 6 WHEN 0 THEN '木造' WHEN 1 THEN '鉄筋コンクリート造' WHEN 2 THEN '軽量鉄骨造' WHEN 3 THEN '鉄骨造' WHEN 4 THEN 'SRC' ELSE NULL END AS structure,
 CASE o_orderkey % 7 WHEN 0 THEN '3LDK' WHEN 1 THEN '4SLDK' WHEN 2 THEN '2DK' WHEN 3 THEN '1K' WHEN 4 THEN '5 LDK' WHEN 5 THEN NULL ELSE 'ワンルーム' END AS floor_plan,
 CASE o_orderkey % 4 WHEN 0 THEN CAST(4.5 AS DOUBLE) WHEN 1 THEN CAST(3.2 AS DOUBLE) WHEN 2 THEN CAST(2.0 AS DOUBLE) ELSE NULL END AS road_width_m,
 CASE o_custkey % 5 WHEN 0 THEN CAST(2.0 AS DOUBLE) WHEN 1 THEN CAST(1.5 AS DOUBLE) WHEN 2 THEN CAST(6.0 AS DOUBLE) ELSE NULL END AS road_frontage_m,
 CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS rebuild_possible,
 CASE o_custkey % 5 WHEN 0 THEN '第一種住居地域' WHEN 1 THEN '商業地域' WHEN 2 THEN '近隣商業地域' WHEN 3 THEN '工業地域' ELSE NULL END AS use_zone,
 CASE WHEN o_orderstatus = 'P' THEN 'sold' ELSE 'active' END AS status, o_orderdate AS created_at
FROM orders
"""

VIEWS["listing_feed"] = """
SELECT CASE l_linenumber % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source,
 concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING)) AS source_id, l_orderkey AS property_id,
 CASE l_partkey % 6 WHEN 0 THEN concat(CAST(CAST(floor(l_extendedprice/CAST(100 AS DOUBLE)) AS BIGINT) AS STRING),'万円')
  WHEN 1 THEN concat('1億',CAST(l_partkey AS STRING),'万円') WHEN 2 THEN concat(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING),'円')
  WHEN 3 THEN '価格未定' WHEN 4 THEN '無料' ELSE concat(CAST(l_suppkey AS STRING),',500 万円') END AS price_text,
 l_shipdate AS scraped_at, l_partkey, l_suppkey FROM lineitem
"""

VIEWS["scrape_jobs"] = """
SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source_id,
 lpad(CAST(user_id % 47 + 1 AS STRING),2,'0') AS prefecture_code,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'completed' END AS status,
 ts AS created_at, CAST(floor(value) AS INT) AS listings_found FROM events
"""

VIEWS["hazard_assessments"] = """
SELECT o_orderkey AS property_id,
 CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(0.0 AS DOUBLE) WHEN 2 THEN CAST(0.3 AS DOUBLE) WHEN 3 THEN CAST(0.5 AS DOUBLE) WHEN 4 THEN CAST(1.0 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END AS flood_depth_max_m,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(1.2 AS DOUBLE) WHEN 2 THEN CAST(1.5 AS DOUBLE) WHEN 3 THEN CAST(2.2 AS DOUBLE) ELSE CAST(300.0 AS DOUBLE) END AS pga_475yr,
 CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'high' WHEN 4 THEN 'very_high' WHEN 5 THEN 'none' ELSE 'unclear' END AS landslide_risk,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(0.0 AS DOUBLE) WHEN 2 THEN CAST(1.0 AS DOUBLE) ELSE CAST(4.0 AS DOUBLE) END AS tsunami_depth_max_m
FROM orders WHERE o_orderkey % 10 <> 3
"""

VIEWS["deals"] = """
SELECT o_orderkey AS id, o_orderkey AS property_id,
 CASE o_custkey % 10 WHEN 0 THEN 'discovery' WHEN 1 THEN 'analysis' WHEN 2 THEN 'due_diligence' WHEN 3 THEN 'negotiation' WHEN 4 THEN 'purchase' WHEN 5 THEN 'renovation' WHEN 6 THEN 'listing' WHEN 7 THEN 'sale' WHEN 8 THEN 'completed' ELSE 'abandoned' END AS stage,
 CAST(floor(o_totalprice * CAST(60 AS DOUBLE)) AS BIGINT) AS purchase_price,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(500000 + o_custkey * 1000 AS BIGINT) END AS renovation_budget,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(floor(o_totalprice * CAST(96 AS DOUBLE)) AS BIGINT) END AS target_sale_price,
 CAST(o_custkey % 120 + 1 AS INT) AS holding_months, o_orderdate AS created_at
FROM orders WHERE o_orderstatus = 'P'
"""

VIEWS["transactions"] = """
SELECT concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING),'-',CAST(l_partkey AS STRING)) AS id,
 concat(lpad(CAST(l_suppkey % 47 + 1 AS STRING),2,'0'), CAST(101 + l_suppkey % 12 AS STRING)) AS municipality_code,
 CASE l_returnflag WHEN 'A' THEN 'detached_house' WHEN 'N' THEN 'land' ELSE 'condo' END AS property_type,
 CAST(floor(l_extendedprice * CAST(100 AS DOUBLE)) AS BIGINT) AS trade_price, l_quantity * CAST(5 AS DOUBLE) AS area_sqm, l_shipdate AS created_at FROM lineitem
"""

VIEWS["landslide_features"] = """
SELECT l_orderkey AS property_id, CASE l_partkey % 3 WHEN 0 THEN 'Steep Slope' WHEN 1 THEN 'landslide' ELSE '' END AS type,
 CASE l_suppkey % 4 WHEN 0 THEN '急傾斜地' WHEN 1 THEN '地すべり防止区域' ELSE '' END AS name,
 CASE l_linenumber WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '4' WHEN 5 THEN 'n/a' ELSE NULL END AS risk FROM lineitem
"""

VIEWS["listing_html"] = """
SELECT o_orderkey AS page_id, CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source_id,
 concat('https://portal.example/kodate/chu/tokyo/', CAST(1000000 + o_orderkey AS STRING), '/') AS url,
 concat('<html><body><h1>物件 ', CAST(o_orderkey AS STRING), '</h1><table><tr><th>価格</th><td>', CAST(CAST(floor(o_totalprice/CAST(100 AS DOUBLE)) AS BIGINT) AS STRING), '万円</td></tr><tr><th>土地面積</th><td>', CAST(30 + o_orderkey % 400 AS STRING), '.5㎡</td></tr></table>',
  '<dl><dt>築年月</dt><dd>', CASE o_orderkey % 3 WHEN 0 THEN '昭和50年' WHEN 1 THEN '2005年3月' ELSE '平成17年' END, '</dd><dt>備考</dt><dd>', CASE o_orderkey % 3 WHEN 0 THEN '再建築不可' WHEN 1 THEN '再建築可' ELSE 'なし' END, '</dd></dl>',
  '<img src="/img/icon.png"><img data-src="//cdn.example/photo', CAST(o_orderkey % 10 AS STRING), '.jpg"></body></html>') AS html FROM orders
"""


def _tokens(sql: str) -> set[str]:
    words: set[str] = set()
    for part in sql.replace(",", " ").replace("(", " ").replace(")", " ").split():
        words.add(part)
    return words


def _inputs(name: str) -> list[str]:
    """Tables or views that view ``name`` selects from."""
    words = _tokens(VIEWS[name])
    return [n for n in [*BASE, *VIEWS] if n != name and n in words]


def bind(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """Run ``sql`` with the tables it selects from bound to ``frames``; braces in it are plain text."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(text, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` (or landed table) over the files in ``sf_dir``."""
    if name not in VIEWS:
        return base_table(spark, sf_dir, name)
    return bind(spark, VIEWS[name], **{n: view(spark, sf_dir, n) for n in _inputs(name)})


def with_views(*names: str, extra: str = "") -> str:
    """A WITH clause defining ``names`` and what they read, then ``extra`` CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered or name not in VIEWS:
            return
        for needed in _inputs(name):
            add(needed)
        ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in ordered]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"


# one incoming listing per customer: exact, one digit more, full width, coordinates only, and unknown address nearby
VIEWS["incoming"] = """
SELECT c_custkey AS key, CASE c_custkey % 5 WHEN 3 THEN NULL ELSE concat(
  CASE c_custkey % 6 WHEN 0 THEN '東京都新宿区西新宿' WHEN 1 THEN '大阪府大阪市北区梅田' WHEN 2 THEN '北海道札幌市中央区大通西' WHEN 3 THEN '長野県松本市中央' WHEN 4 THEN '京都府京都市中京区' ELSE '山形県山形市七日町' END,
  CASE c_custkey % 5 WHEN 2 THEN '　' WHEN 4 THEN '字上野原九十番地' ELSE '' END,
  CAST(c_custkey % 9 + 1 AS STRING), '-', CAST(c_custkey % 20 + 1 AS STRING), '-', CAST(c_custkey % 15 + 1 AS STRING),
  CASE c_custkey % 5 WHEN 1 THEN '7' ELSE '' END) END AS address,
 CASE c_custkey % 6 WHEN 0 THEN '新宿区' WHEN 1 THEN '大阪市' WHEN 2 THEN '札幌市' WHEN 3 THEN '松本市' WHEN 4 THEN '京都市' ELSE '山形市' END AS municipality,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(30 AS DOUBLE) + CAST(c_custkey * 7919 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) + CAST(0.0003 AS DOUBLE) END AS lat,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(130 AS DOUBLE) + CAST(c_custkey * 6007 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) + CAST(0.0001 AS DOUBLE) END AS lng
FROM customer
"""

# point features with a risk class, one per part
VIEWS["risk_points"] = """
SELECT CAST(30 AS DOUBLE) + CAST(p_partkey * 7919 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat,
 CAST(130 AS DOUBLE) + CAST(p_partkey * 6007 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) + CAST(0.004 AS DOUBLE) AS lng,
 CASE p_partkey % 3 WHEN 0 THEN 'Steep Slope' WHEN 1 THEN 'landslide' ELSE '' END AS type,
 CASE p_size % 4 WHEN 0 THEN '急傾斜地' WHEN 1 THEN '地すべり防止区域' ELSE '' END AS name,
 CASE p_size % 6 WHEN 0 THEN NULL WHEN 5 THEN 'n/a' ELSE CAST(p_size % 6 AS STRING) END AS risk
FROM part
"""

# landed API responses: three kinds per order, some failed (no body), some empty, some with other key names
VIEWS["hazard_responses"] = """
SELECT o_orderkey AS property_id, 'pshm' AS kind, CASE o_custkey % 7 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '{"type":"FeatureCollection","features":[]}'
  WHEN 2 THEN concat('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"P_I45_T30":"0.', CAST(o_custkey % 90 + 10 AS STRING), '","T30_I50_P":"n/a"}}]}')
  ELSE concat('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"T30_I45_P":"0.', CAST(o_custkey % 90 + 10 AS STRING), '","T30_I50_P":"0.125","T30_I55_P":"0.0625","T30_I65_P":"0.5"}}]}') END AS body FROM orders
UNION ALL SELECT o_orderkey, 'avghazard', CASE o_orderkey % 6 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '{"type":"FeatureCollection","features":[]}'
  WHEN 2 THEN concat('{"features":[{"properties":{"PGA_475":"bad","AVS":"', CAST(o_custkey % 500 + 100 AS STRING), '.126"}}]}')
  WHEN 3 THEN concat('{"features":[{"properties":{"PGA_475":"1.', CAST(o_custkey % 900 + 100 AS STRING), '","VS30":"', CAST(o_custkey % 500 + 100 AS STRING), '"}}]}')
  WHEN 4 THEN '{"features":[{"properties":{"ARV":"2.675","J_AVS":"x"}}]}'
  ELSE concat('{"features":[{"properties":{"PGA":"0.', CAST(o_custkey % 90 + 10 AS STRING), '5","AVS":"","J_AVS":"180"}}]}') END FROM orders
UNION ALL SELECT o_orderkey, 'landslide', CASE o_orderkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN '{"features":[]}'
  WHEN 2 THEN '{"features":[{"properties":{"type":"Steep Slope","risk":"2"}},{"properties":{"name":"地すべり防止区域","rank":"3"}}]}'
  WHEN 3 THEN concat('{"features":[{"properties":{"type":"landslide","risk":"","R":"', CAST(o_custkey % 6 AS STRING), '"}}]}')
  ELSE '{"features":[{"properties":{"risk":"n/a","name":"急傾斜地"}}]}' END FROM orders
"""

# tile files at zoom 15 around customers: one layer each, some empty
VIEWS["tile_files"] = """
SELECT concat('/landing/', layer, '/15/', CAST(x AS STRING), '/', CAST(y AS STRING), '.png') AS path, n AS length FROM (
 SELECT CASE c_custkey % 6 WHEN 0 THEN 'flood' WHEN 1 THEN 'tsunami' WHEN 2 THEN 'disaster_zone' WHEN 3 THEN 'landslide_prevention' WHEN 4 THEN 'steep_slope_zone' ELSE 'storm_surge' END AS layer,
  CAST(floor((lng + CAST(180 AS DOUBLE)) / CAST(360 AS DOUBLE) * CAST(32768 AS DOUBLE)) AS INT) AS x,
  CAST(floor((CAST(1 AS DOUBLE) - ln(tan(radians(lat)) + CAST(1 AS DOUBLE) / cos(radians(lat))) / pi()) / CAST(2 AS DOUBLE) * CAST(32768 AS DOUBLE)) AS INT) AS y,
  c_custkey % 4 AS n
 FROM (SELECT c_custkey, CAST(30 AS DOUBLE) + CAST(c_custkey * 7919 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat,
  CAST(130 AS DOUBLE) + CAST(c_custkey * 6007 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lng FROM customer) t) u
"""

# population by third-level grid cell, from part points
VIEWS["mesh_population"] = """
SELECT concat(lpad(CAST(p AS STRING),2,'0'), lpad(CAST(u AS STRING),2,'0'), CAST(q AS STRING), CAST(v AS STRING), CAST(r AS STRING), CAST(w AS STRING)) AS mesh_code,
 CAST(sum(p_size) AS BIGINT) AS population_current, CAST(max(p_size) AS INT) AS elderly FROM (
 SELECT p, u, q, v, CAST(floor((m - q * CAST(5 AS DOUBLE)) * CAST(60 AS DOUBLE) / CAST(30 AS DOUBLE)) AS INT) AS r,
  CAST(floor((d - v * CAST(7.5 AS DOUBLE) / CAST(60 AS DOUBLE)) * CAST(3600 AS DOUBLE) / CAST(45 AS DOUBLE)) AS INT) AS w, p_size FROM (
  SELECT p, u, m, d, CAST(floor(m / CAST(5 AS DOUBLE)) AS INT) AS q, CAST(floor(d * CAST(60 AS DOUBLE) / CAST(7.5 AS DOUBLE)) AS INT) AS v, p_size FROM (
   SELECT p, u, lat * CAST(60 AS DOUBLE) - p * CAST(40 AS DOUBLE) AS m, lng - CAST(100 AS DOUBLE) - u AS d, p_size FROM (
    SELECT lat, lng, p_size, CAST(floor(lat * CAST(60 AS DOUBLE) / CAST(40 AS DOUBLE)) AS INT) AS p, CAST(floor(lng - CAST(100 AS DOUBLE)) AS INT) AS u FROM (
     SELECT p_size, CAST(30 AS DOUBLE) + CAST(p_partkey * 7919 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lat,
      CAST(130 AS DOUBLE) + CAST(p_partkey * 6007 % 150000 AS DOUBLE)/CAST(10000 AS DOUBLE) AS lng FROM part) a) b) c) e) f
GROUP BY p, u, q, v, r, w
"""

# a batch of listings: every order twice, the second sighting a day later with some gaps
VIEWS["feed_batch"] = """
SELECT source, source_id, concat('https://portal.example/', source_id) AS source_url, concat('物件 ', source_id) AS title,
 CASE WHEN seen = 1 AND k % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE price + seen * 10000 END AS price,
 address, pref AS prefecture, CASE WHEN k % 2 = 0 THEN CAST(10000 + k % 47 AS STRING) ELSE '松本市' END AS municipality,
 CASE WHEN seen = 1 AND k % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(50 + k % 200 AS DOUBLE) END AS land_area_sqm, CAST(NULL AS DOUBLE) AS building_area_sqm,
 CASE WHEN seen = 1 THEN '' ELSE '3LDK' END AS floor_plan, CAST(1950 + k % 70 AS INT) AS year_built, '木造' AS structure, CAST(2 AS INT) AS floors,
 CASE k % 3 WHEN 0 THEN CAST(4.5 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END AS road_width_m, CAST(NULL AS DOUBLE) AS road_frontage_m,
 CASE k % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS rebuild_possible, CAST(NULL AS STRING) AS city_planning_zone, '商業地域' AS use_zone,
 CAST(60 AS DOUBLE) AS coverage_ratio, CAST(200 AS DOUBLE) AS floor_area_ratio,
 CASE WHEN seen = 1 AND k % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(35 AS DOUBLE) + CAST(k % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
 CAST(139 AS DOUBLE) AS longitude, seen, k, ts AS scraped_at
FROM (SELECT 0 AS seen, o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source,
  concat('F', CAST(o_orderkey AS STRING)) AS source_id, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderdate AS ts, lpad(CAST(o_custkey % 47 + 1 AS STRING),2,'0') AS pref,
  CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 8 = 1 THEN 'Unknown' ELSE concat('長野県松本市中央', CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 4 AS STRING)) END AS address FROM orders
 UNION ALL SELECT 1, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END,
  concat('F', CAST(o_orderkey AS STRING)), CAST(floor(o_totalprice) AS BIGINT), o_orderdate + INTERVAL 1 DAY, lpad(CAST(o_custkey % 47 + 1 AS STRING),2,'0'),
  CASE WHEN o_orderkey % 8 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 8 = 1 THEN 'Unknown' ELSE concat('長野県松本市中央', CAST(o_custkey AS STRING), '-', CAST(o_orderkey % 4 AS STRING)) END FROM orders) t
"""

# properties and listings stored before that batch: one property per customer, one listing for a share of the orders
VIEWS["stored_properties"] = """
SELECT concat('P', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 9 = 0 THEN 'Unknown' ELSE concat('長野県松本市中央', CAST(c_custkey AS STRING), '-', CAST(c_custkey % 4 AS STRING)) END AS address_ja,
 lpad(CAST(c_custkey % 47 + 1 AS STRING),2,'0') AS prefecture_code, '20202' AS municipality_code, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng,
 CAST(floor(abs(c_acctbal) * CAST(1000 AS DOUBLE)) AS BIGINT) AS price_jpy, CAST(80 AS DOUBLE) AS land_area_sqm, CAST(90 AS DOUBLE) AS building_area_sqm, '2DK' AS floor_plan, CAST(1980 AS INT) AS year_built,
 CAST(NULL AS STRING) AS structure, CAST(NULL AS INT) AS floors, CAST(3 AS DOUBLE) AS road_width_m, CAST(NULL AS BOOLEAN) AS rebuild_possible, CAST(NULL AS STRING) AS use_zone,
 CAST(NULL AS DOUBLE) AS coverage_ratio, CAST(NULL AS DOUBLE) AS floor_area_ratio, CAST(1 AS DOUBLE) AS price_per_sqm, 'active' AS status
FROM customer
"""

VIEWS["stored_listings"] = """
SELECT concat('P', CAST(o_custkey AS STRING)) AS property_id, CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source_id,
 concat('F', CAST(o_orderkey AS STRING)) AS source_listing_id, 'https://portal.example/old' AS source_url, 'delisted' AS listing_status,
 o_orderdate - INTERVAL 9 DAY AS first_scraped_at, o_orderdate - INTERVAL 9 DAY AS last_scraped_at FROM orders WHERE o_orderpriority = '1-URGENT'
"""

# search result pages: one per order with two cards, in the markup of its portal
VIEWS["search_html"] = """
SELECT o_orderkey AS page_id, source, 'https://portal.example/search' AS url, 'search' AS kind, concat('<html><body><div class="list">', CASE source
 WHEN 'suumo' THEN concat('<div class="property_unit"><h2>中古一戸建て', k, '</h2><a href="/chukoikkodate/nc_', k, '/">x</a><div class="dottable-value">', man, '万円</div><div class="dottable-vm">長野県松本市', k, '</div><table><tr><th>土地面積</th><td>', area, '.5㎡</td></tr><tr><th>間取り</th><td>3LDK</td></tr><tr><th>築年月</th><td>1998年4月</td></tr></table></div><div class="property_unit"><a href="/chukoikkodate/none/">y</a></div>')
 WHEN 'homes' THEN concat('<div class="mod-mergeBuilding"><h2>中古一戸建て', k, '</h2><a href="/kodate/chu/nagano/1', k, '00000/">x</a><span class="price">', man, '万円</span><p class="address">長野県松本市', k, '</p><dl><dt>土地</dt><dd>', area, '.5m²</dd><dt>間取り</dt><dd>3LDK</dd><dt>築年</dt><dd>1998年</dd></dl></div><div class="mod-mergeBuilding"><span>no link</span></div>')
 WHEN 'athome' THEN concat('<div class="property-card"><h3>中古一戸建て', k, '</h3><a href="https://www.athome.co.jp/kodate/1', k, '00000/">x</a><span class="kakaku">', man, '万円</span><table><tr><th>所在地</th><td>長野県松本市', k, '</td></tr><tr><th>敷地</th><td>', area, '.5㎡</td></tr><tr><th>間取り</th><td>3LDK</td></tr><tr><th>築年月</th><td>平成10年</td></tr></table></div><div class="property-card"><a href="/kodate/list/">z</a></div>')
 WHEN 'akiya' THEN concat('<section class="propety"><p class="propetyTitle"><a href="//muni.akiya-athome.jp/bukken/detail/buy/', k, '">中古一戸建て', k, '</a></p><dl class="price"><dt>価格</dt><dd><span>', man, '</span>万円</dd></dl><dl><dt>所在地</dt><dd>長野県松本市', k, '</dd><dt>土地面積</dt><dd>', area, '.5㎡</dd><dt>間取り</dt><dd>3LDK</dd><dt>築年月</dt><dd>平成10年</dd></dl><img data-src="/img/p', k, '.jpg"><img src="/icon.png"></section><section class="propety"><span>a</span></section>')
 ELSE concat('<table class="result-table"><tbody><tr><td>長野地裁松本支部</td><td>令和6年(ケ)第', CAST(o_orderkey % 900 + 1 AS STRING), '号</td><td>', man, '0,000円</td><td>長野県松本市', k, '</td><td>令和7年3月1日</td><td><a href="/app/detail/pt001?id=B', k, '">詳細</a></td></tr><tr><th>x</th></tr></tbody></table>') END, '</div></body></html>') AS html,
 o_orderkey, CAST(floor(o_totalprice / CAST(100 AS DOUBLE)) AS BIGINT) + 1 AS price_man, 30 + o_orderkey % 400 AS area_int
FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source, CAST(o_orderkey AS STRING) AS k,
 CAST(CAST(floor(o_totalprice / CAST(100 AS DOUBLE)) AS BIGINT) + 1 AS STRING) AS man, CAST(30 + o_orderkey % 400 AS STRING) AS area FROM orders) t
"""


# detail pages with what only some portals embed: linked data, script coordinates, carousels, court papers, area inputs
VIEWS["rich_html"] = """
SELECT o_orderkey AS page_id, source, CASE source WHEN 'homes' THEN concat('https://www.homes.co.jp/kodate/b/?bid=', k) WHEN 'bit' THEN concat('https://www.bit.courts.go.jp/app/detail/pt001/', k, '?x=1')
  WHEN 'akiya' THEN concat('https://muni.akiya-athome.jp/bukken/detail/buy/', k) WHEN 'suumo' THEN concat('https://suumo.jp/chukoikkodate/__x/nc_9/ab', k, '/') ELSE concat('https://www.athome.co.jp/kodate/', CAST(o_orderkey + 100000 AS STRING), '/?a=b') END AS url, 'detail' AS kind,
 concat('<html><head><title>物件ページ', k, '</title></head><body><h1>物件 ', k, '</h1>', CASE source
 WHEN 'homes' THEN concat('<script type="application/ld+json">{"@type":"House","offers":{"price":"', man, '0000"},"address":{"addressRegion":"長野県","addressLocality":"松本市","streetAddress":"中央', k, '"},"geo":{"latitude":"36.', tail, '","longitude":137.5},"image":["https://x/', k, '.jpg"]}</script><dl><dt>階数</dt><dd>地上2階</dd><dt>その他制限事項</dt><dd>再建築不可</dd></dl>')
 WHEN 'athome' THEN concat('<script>var m = {lat: 36.', tail, ', lng: 138.25};</script><table><tr><th>所在地</th><td>長野県松本市', k, '</td></tr><tr><th>階建</th><td>2階建 / 3 階</td></tr><tr><th>特記事項</th><td>再建築可</td></tr></table><img src="https://img.athome.co.jp/logo.png"><img data-src="https://img.athome.co.jp/', k, '.jpg"><div style="background-image: url(&quot;https://bg/', k, '.png&quot;)"></div>')
 WHEN 'akiya' THEN concat('<script>image_tile_carousel_image_s = [{"image_url_fullsize": "//c/', k, '.jpg"}, {"image_url_thumbnail": "https://c/t.jpg"}];</script><iframe src="https://maps.google.com/maps?q=36.', tail, ',138.5"></iframe><dl><dt>所在地周辺情報を調べる</dt><dd>長野県松本市', k, '周辺情報を見る</dd><dt>希望価格</dt><dd>応相談</dd><dt>金額</dt><dd>', man, '万円</dd></dl><input name="gyosei_cd[]" value="20202"><input name="gyosei_cd[]" value="2', tail, '">')
 WHEN 'bit' THEN concat('<p>令和6年(ケ)第', CAST(o_orderkey % 900 + 1 AS STRING), '号</p><dl><dt>裁判所名</dt><dd>長野地裁</dd><dt>売却基準価額</dt><dd>', man, '0,000円</dd><dt>所在地</dt><dd>長野県松本市', k, '</dd></dl><a href="/pdf/', k, '.pdf">物件明細書</a><script>latitude = 36.', tail, '; lng = 200.5;</script><img src="/img/btn_x.png"><img src="/img/', k, '.jpg">')
 ELSE concat('<table><tr><th>価格</th><td>', man, '万円</td></tr><tr><th>住所</th><td>東京都新宿区西新宿', k, '</td></tr></table><img src="https://img.suumo.jp/a', k, '.jpg"><img src="https://img.suumo.jp/a', k, '.jpg">') END, '</body></html>') AS html,
 k, man, tail
FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source, CAST(o_orderkey AS STRING) AS k,
 CAST(CAST(floor(o_totalprice / CAST(100 AS DOUBLE)) AS BIGINT) + 1 AS STRING) AS man, CAST(1000 + o_orderkey % 9000 AS STRING) AS tail FROM orders) t
"""

# prices that crawls found for a listing, at times no price
VIEWS["sightings"] = """
SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source,
 concat('L', CAST(user_id AS STRING)) AS listing_id,
 CASE event_type WHEN 'error' THEN CAST(NULL AS BIGINT) ELSE 5000000 + 1000000 * CAST(floor(value / CAST(25 AS DOUBLE)) AS BIGINT) END AS price, ts AS scraped_at FROM events
"""

# what the daily runs of each source found
VIEWS["crawl_sightings"] = """
SELECT CASE user_id % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source,
 concat('L', CAST(user_id AS STRING)) AS listing_id, CAST(ts AS DATE) AS run_day, event_type <> 'error' AS found FROM events
"""

# one saved search per customer
VIEWS["saved_searches"] = """
SELECT c_custkey AS search_id, CAST(concat(CAST(1996 + c_custkey % 5 AS STRING), '-06-01') AS DATE) AS since,
 CASE WHEN c_custkey % 4 IN (1, 2) THEN lpad(CAST(c_custkey * 7 % 47 + 1 AS STRING), 2, '0') ELSE CAST(NULL AS STRING) END AS prefecture_code,
 CASE WHEN c_custkey % 4 = 0 THEN concat(lpad(CAST(c_custkey * 7 % 47 + 1 AS STRING), 2, '0'), CAST(101 + c_custkey * 7 % 12 AS STRING)) ELSE CAST(NULL AS STRING) END AS municipality_code,
 CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(c_custkey * 104729 % 20000000 AS BIGINT) END AS price_min,
 CASE WHEN c_custkey % 5 = 1 AND c_custkey % 4 < 3 THEN CAST(NULL AS BIGINT) ELSE CAST(c_custkey * 104729 % 20000000 + 150000 + c_custkey % 7 * 50000 AS BIGINT) END AS price_max,
 CASE c_custkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS rebuild_possible,
 CASE WHEN c_custkey % 3 = 0 THEN CAST(100 AS DOUBLE) + CAST(c_custkey % 200 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END AS land_min
FROM customer
"""

# one map view per customer, from a few hundred metres to a few degrees
VIEWS["viewports"] = """
SELECT c_custkey AS box_id, lat - h AS south, lng - w AS west, lat + h AS north, lng + w AS east FROM (
 SELECT c_custkey, CAST(30 AS DOUBLE) + CAST(c_custkey * 7919 % 150000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat, CAST(130 AS DOUBLE) + CAST(c_custkey * 6007 % 150000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS lng,
  CASE c_custkey % 4 WHEN 0 THEN CAST(0.002 AS DOUBLE) WHEN 1 THEN CAST(0.05 AS DOUBLE) WHEN 2 THEN CAST(0.4 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) + CAST(c_custkey % 9 AS DOUBLE) / CAST(10 AS DOUBLE) END AS h,
  CASE c_custkey % 3 WHEN 0 THEN CAST(0.003 AS DOUBLE) WHEN 1 THEN CAST(0.08 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS w FROM customer) t
"""

# schools, surgeries and shops with the people who live there
VIEWS["facilities"] = """
SELECT p_partkey AS id, CAST(30 AS DOUBLE) + CAST(p_partkey * 7919 % 150000 AS DOUBLE) / CAST(10000 AS DOUBLE) + CAST(p_size % 5 AS DOUBLE) * CAST(0.002 AS DOUBLE) AS lat,
 CAST(130 AS DOUBLE) + CAST(p_partkey * 6007 % 150000 AS DOUBLE) / CAST(10000 AS DOUBLE) + CAST(0.004 AS DOUBLE) AS lng,
 CASE p_size % 3 WHEN 0 THEN 'school' WHEN 1 THEN 'medical' ELSE 'shop' END AS kind, CASE WHEN p_size % 7 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(p_size AS BIGINT) * 10 END AS residents FROM part
"""
