"""Queries: text, address, number and date expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.functions import numbers as N
from proplytics.functions import text as T
from proplytics.operators import deals as deal_ops
from proplytics.operators import enrich
from proplytics.plans import twins as D
from proplytics.plans.registry import query
from proplytics.plans.twins import over
from proplytics.sources.dimensions import PREFECTURES
from proplytics.sources.views import bind

FEED = "SELECT source, source_id, l_partkey, l_suppkey, price_text"


def _price(name: str, parse, twin: str):
    @query(name, over("listing_feed", sql=f"{FEED}, {twin} AS price FROM listing_feed"))
    def run(s):
        return s.listing_feed.select(
            "source", "source_id", "l_partkey", "l_suppkey", "price_text", parse(F.col("price_text")).alias("price")
        )


_price("txt01_price_portal", T.parse_price_portal, D.price_portal("price_text"))
_price("txt02_price_akiya", T.parse_price_akiya, D.price_akiya("price_text"))
_price("txt03_price_auction", T.parse_price_auction, D.price_auction("price_text"))


@query(
    "txt01_price_by_source",
    over("listing_feed", sql=f"""SELECT source, count(*) AS n, count(price) AS priced, count(*) FILTER (price = 0) AS free,
 CAST(sum(price) AS BIGINT) AS total FROM (SELECT source, {D.price_any('source', 'price_text')} AS price FROM listing_feed) GROUP BY source"""),
)
def _price_by_source(s):
    priced = s.listing_feed.select("source", T.parse_price(F.col("source"), F.col("price_text")).alias("price"))
    return priced.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.count_if(F.col("price") == 0).alias("free"),
        F.sum("price").alias("total"),
    )


# area, year and number texts made from the order lines
_AREA_TEXT = """concat(CASE l_partkey % 4 WHEN 0 THEN '１' WHEN 1 THEN '1,' ELSE '' END, CAST(l_partkey AS STRING), '.',
 CAST(l_linenumber AS STRING), CASE l_suppkey % 5 WHEN 0 THEN '㎡' WHEN 1 THEN ' m²' WHEN 2 THEN 'm2' WHEN 3 THEN '平米' ELSE '坪' END)"""
AREAS = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_AREA_TEXT} AS area_text FROM lineitem"
_a = D.digits("area_text")


@query(
    "txt04_area",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, area_text,
 TRY_CAST({D.group(_a, '([\\d.]+)\\s*[m㎡²]')} AS DOUBLE) AS portal,
 TRY_CAST(replace({D.group(_a, '([\\d,.]+)\\s*[m㎡²]')}, ',', '') AS DOUBLE) AS akiya,
 TRY_CAST({D.group(f"replace({_a}, ',', '')", '([\\d.]+)\\s*(?:m[²2]|㎡|平米|平方メートル)')} AS DOUBLE) AS auction
FROM ({AREAS})""",
)
def _area(s):
    rows = bind(s.spark, AREAS, lineitem=s.lineitem)
    c = F.col("area_text")
    return rows.withColumns(
        {"portal": T.parse_area_portal(c), "akiya": T.parse_area_akiya(c), "auction": T.parse_area_auction(c)}
    )


_YEAR_TEXT = """concat(CASE o_orderkey % 7 WHEN 0 THEN '令和' WHEN 1 THEN '平成' WHEN 2 THEN '昭和 ' WHEN 3 THEN '大正' WHEN 4 THEN '明治'
 WHEN 5 THEN '築' ELSE '平成元年/' END, CASE WHEN o_orderkey % 3 = 0 THEN CAST(1700 + o_custkey % 500 AS STRING)
 ELSE CAST(o_custkey % 60 + 1 AS STRING) END, CASE o_orderkey % 2 WHEN 0 THEN '年' ELSE '年3月' END)"""
YEARS = f"SELECT o_orderkey, {_YEAR_TEXT} AS year_text FROM orders"


def _g_int(pattern: str, n: int = 1) -> str:
    return f"TRY_CAST({D.group('year_text', pattern, n)} AS INT)"


def _eras(names: list[str]) -> str:
    return ", ".join(f"{T.ERA_BASE[e]} + {_g_int(e + '(\\d+)年')}" for e in names)


_SANE = "CASE WHEN {y} BETWEEN 1868 AND 2100 THEN {y} END"
_ERA_CASE = "CASE {e} " + " ".join(f"WHEN '{e}' THEN {b}" for e, b in T.ERA_BASE.items()) + " END"
_AKIYA_ERA = r"(令和|平成|昭和|大正|明治)\s*(\d+)\s*年"
_FREE_ERA = r"(令和|平成|昭和|大正|明治)(\d+)年?"


@query(
    "txt05_year",
    f"""SELECT o_orderkey, year_text, coalesce({_g_int('(\\d{4})年')}, {_eras(['令和', '平成', '昭和', '大正'])}) AS portal,
 coalesce({_SANE.format(y=_g_int('(\\d{4})\\s*年'))}, {_ERA_CASE.format(e=f"regexp_extract(year_text, '{_AKIYA_ERA}', 1)")} + {_g_int(_AKIYA_ERA, 2)}) AS akiya,
 coalesce({_SANE.format(y=_g_int('(\\d{4})年'))}, {_eras(list(T.ERA_BASE))}) AS auction
FROM ({YEARS})""",
)
def _year(s):
    rows = bind(s.spark, YEARS, orders=s.orders)
    c = F.col("year_text")
    return rows.withColumns(
        {"portal": T.parse_year_portal(c), "akiya": T.parse_year_akiya(c), "auction": T.parse_year_auction(c)}
    )


@query(
    "dt01_era_to_year",
    f"""SELECT o_orderkey, year_text, {_ERA_CASE.format(e=f"regexp_extract(year_text, '{_FREE_ERA}', 1)")}
 + {_g_int(_FREE_ERA, 2)} AS year FROM ({YEARS})""",
)
def _era(s):
    rows = bind(s.spark, YEARS, orders=s.orders)
    return rows.withColumn("year", T.era_to_year(F.col("year_text")))


_d = D.digits("text")


@query(
    "txt06_numbers",
    f"""SELECT doc_id, TRY_CAST({D.group(_d, '([\\d.]+)')} AS DOUBLE) AS first_float, TRY_CAST({D.group(_d, '(\\d+)')} AS INT) AS first_int,
 TRY_CAST(replace({D.group(_d, '([\\d,.]+)')}, ',', '') AS DOUBLE) AS comma_float,
 TRY_CAST({D.group(f"replace({_d}, ',', '')", '([\\d.]+)')} AS DOUBLE) AS auction_float,
 TRY_CAST({D.group(f"concat({_d}, ' ', CAST(doc_id % 9 AS VARCHAR), ' 階建')", '(\\d+)\\s*階')} AS INT) AS floors FROM documents""",
)
def _numbers(s):
    c = F.col("text")
    storeys = F.concat(c, F.lit(" "), (F.col("doc_id") % 9).cast("string"), F.lit(" 階建"))
    return s.documents.select(
        "doc_id",
        T.parse_float(c).alias("first_float"),
        T.parse_int(c).alias("first_int"),
        T.parse_float_commas(c).alias("comma_float"),
        T.parse_float_auction(c).alias("auction_float"),
        T.parse_floors(storeys).alias("floors"),
    )


_PORTAL = T.PORTAL_PREFECTURE
_MUNI_BIT = _PORTAL + "((?:[^市区町村郡]+?[市区町村郡](?:[^市区町村]+?[市区町村])?))?"
_CODE = "CASE {c} " + " ".join(f"WHEN '{p[1]}' THEN '{p[0]}'" for p in PREFECTURES) + " END"


@query(
    "txt07_address_split",
    over("properties", sql=f"""SELECT id, address_ja, {D.group('address_ja', _PORTAL)} AS prefecture,
 {D.group('address_ja', _PORTAL + '(.+?[市区町村郡])', 2)} AS municipality,
 {D.group('address_ja', '^(北海道|.{2,3}[都道府県])')} AS akiya_prefecture,
 {D.group('address_ja', '[都道府県](.*?[市区町村郡])')} AS akiya_municipality,
 {D.group('address_ja', _MUNI_BIT, 2)} AS auction_municipality,
 {_CODE.format(c=D.group('address_ja', _PORTAL))} AS code FROM properties"""),
)
def _split(s):
    a = F.col("address_ja")
    return s.properties.select(
        "id",
        "address_ja",
        T.prefecture_portal(a).alias("prefecture"),
        T.municipality_portal(a).alias("municipality"),
        T.prefecture_akiya(a).alias("akiya_prefecture"),
        T.municipality_akiya(a).alias("akiya_municipality"),
        T.municipality_auction(a).alias("auction_municipality"),
        T.prefecture_code(T.prefecture_portal(a)).alias("code"),
    )


@query(
    "txt08_prefecture",
    over("properties", sql=f"""SELECT prefecture, count(*) AS n FROM (SELECT {D.group('address_ja', '^(' + D.PREFECTURE_ALTERNATION + ')')} AS prefecture
 FROM properties) GROUP BY prefecture"""),
)
def _prefecture(s):
    return s.properties.groupBy(T.extract_prefecture(F.col("address_ja")).alias("prefecture")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("txt09_width", f"""SELECT doc_id, {D.width("concat(text, '　Ａ１－', CAST(doc_id AS VARCHAR))")} AS text FROM documents""")
def _width(s):
    wide = F.concat(F.col("text"), F.lit("　Ａ１－"), F.col("doc_id").cast("string"))
    return s.documents.select("doc_id", T.normalize_width(wide).alias("text"))


@query("txt09_nfkc")
def _nfkc(s):
    """Full compatibility normalisation; DuckDB has no NFKC, so pytest checks it."""
    return s.documents.select("doc_id", T.normalize_nfkc(F.col("text")).alias("text"))


_KANJI_TEXT = """concat('千代田区', CASE o_custkey % 5 WHEN 0 THEN '二十三番' WHEN 1 THEN '百五' WHEN 2 THEN '〇' WHEN 3 THEN '一二三' ELSE '三千四百十' END,
 '丁目', CAST(o_custkey AS STRING))"""
KANJI = f"SELECT o_orderkey, {_KANJI_TEXT} AS text FROM orders"


@query("txt10_kanji_numerals", f"SELECT o_orderkey, text, {D.kanji('text')} AS folded FROM ({KANJI})")
def _kanji(s):
    rows = bind(s.spark, KANJI, orders=s.orders)
    return rows.withColumn("folded", T.kanji_to_arabic(F.col("text")))


@query("txt11_normalize_address", over("properties", sql=f"SELECT id, address_ja, {D.normalized('address_ja')} AS normalized FROM properties"))
def _normalize(s):
    return s.properties.select("id", "address_ja", T.normalize_address(F.col("address_ja")).alias("normalized"))


_DECORATED = "concat(address_ja, CASE id % 5 WHEN 0 THEN ' （中央ビル）' WHEN 1 THEN ' 101号室 東' WHEN 2 THEN ' 3F 店舗' WHEN 3 THEN ' メゾン青葉' ELSE '' END)"


def simplified(c: str) -> str:
    sp = "[\\s　]"
    t = f"regexp_replace({c}, '[（(].*?[）)]', '', 'g')"
    t = f"regexp_replace({t}, '{sp}*\\d+号室.*$', '', 'g')"
    t = f"regexp_replace({t}, '{sp}*\\d+F.*$', '', 'g')"
    t = f"regexp_replace({t}, '(\\d+-\\d+-\\d+){sp}+.*$', '\\1', 'g')"
    return f"regexp_replace({t}, '^{sp}+|{sp}+$', '', 'g')"


@query("txt12_simplify_address", over("properties", sql=f"SELECT id, {simplified(_DECORATED)} AS simple FROM properties"))
def _simplify(s):
    tail = F.element_at(
        F.array(*[F.lit(x) for x in (" （中央ビル）", " 101号室 東", " 3F 店舗", " メゾン青葉", "")]),
        (F.col("id") % 5 + 1).cast("int"),
    )
    return s.properties.select("id", T.simplify_address(F.concat("address_ja", tail)).alias("simple"))


@query(
    "txt13_clean_whitespace",
    """SELECT count(*) FILTER (regexp_matches(text, '[\\n\\r\\t]')) AS changed, count(*) AS total,
 sum(length(CASE WHEN regexp_matches(text, '[\\n\\r\\t]') THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE text END))::BIGINT AS chars FROM documents""",
)
def _clean(s):
    c = F.col("text")
    return s.documents.agg(
        F.count_if(T.has_control_space(c)).alias("changed"),
        F.count(F.lit(1)).alias("total"),
        F.sum(F.length(T.clean_whitespace(c))).alias("chars"),
    )


_BI = "list_distinct(list_transform(range(1, length({c})), lambda i: substring({c}, i, 2)))"


@query(
    "txt14_bigram_jaccard",
    over("properties", sql=f"""SELECT id, CASE WHEN a = b THEN 1::DOUBLE ELSE
 len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS similarity
FROM (SELECT id, a, b, {_BI.format(c='a')} AS x, {_BI.format(c='b')} AS y
 FROM (SELECT id, address_ja AS a, concat(substring(address_ja, 1, 9), prefecture_code) AS b FROM properties))"""),
)
def _jaccard(s):
    a, b = F.col("address_ja"), F.concat(F.substring("address_ja", 1, 9), F.col("prefecture_code"))
    return s.properties.select("id", T.jaccard(a, b).alias("similarity"))


@query("txt15_truncate", "SELECT doc_id, length(substring(text, 1, 5000)) AS n FROM documents")
def _truncate(s):
    return s.documents.select("doc_id", F.length(T.truncate(F.col("text"))).cast("bigint").alias("n"))


@query(
    "txt16_api_batches",
    """SELECT doc_id, no AS piece, (rn - 1) // 128 AS batch, (rn - 1) % 128 AS position, substring(text, no * 5000 + 1, 5000) AS text
FROM (SELECT doc_id, text, i::INT AS no, row_number() OVER (ORDER BY doc_id, i) AS rn FROM documents, unnest(range(0, (length(text) + 4999) // 5000)) AS t(i) WHERE trim(text) <> '')""",
)
def _batches(s):
    return enrich.api_batches(s.documents, "doc_id")


_TYPES = ["image/png", "IMAGE/JPEG; q=1", "image/webp", "image/avif", "text/html", "image/gif"]


@query(
    "txt17_storage_path",
    """SELECT l_orderkey, l_linenumber, l_partkey, concat('properties/', CAST(l_orderkey AS VARCHAR), '/', CAST(l_linenumber AS VARCHAR),
 CASE l_partkey % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.webp' WHEN 3 THEN '.avif' WHEN 4 THEN '.jpg' ELSE '.gif' END) AS path FROM lineitem""",
)
def _storage(s):
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("l_partkey") % 6 + 1).cast("int"))
    path = T.storage_path(F.col("l_orderkey"), F.col("l_linenumber"), kind)
    return s.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", path.alias("path"))


@query(
    "txt18_risk_label",
    over("hazard_assessments", sql="""SELECT label, count(*) AS n FROM (SELECT CASE lower(landslide_risk) WHEN 'very_high' THEN 'Very High'
 ELSE upper(substring(landslide_risk, 1, 1)) || substring(lower(landslide_risk), 2) END AS label FROM hazard_assessments) GROUP BY label"""),
)
def _label(s):
    return s.hazard_assessments.groupBy(T.risk_label(F.col("landslide_risk")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- numbers ----------------------------------------------------------------


@query(
    "num01_yen",
    over("properties", sql="""SELECT id, concat('¥', format('{:,}', price_jpy)) AS yen, price_jpy / 10000.0::DOUBLE AS man,
 CASE WHEN price_jpy % 10000 = 0 THEN concat(CAST(price_jpy // 10000 AS VARCHAR), '万円')
  ELSE concat(format('{:.1f}', price_jpy / 10000.0::DOUBLE), '万円') END AS man_label,
 CAST(trunc(price_jpy / 10000.0::DOUBLE * 10000.0::DOUBLE) AS BIGINT) AS back FROM properties"""),
)
def _yen(s):
    p = F.col("price_jpy")
    return s.properties.select(
        "id", N.format_yen(p).alias("yen"), N.yen_to_man(p).alias("man"), N.format_man_yen(p).alias("man_label"),
        N.man_to_yen(N.yen_to_man(p)).alias("back"),
    )


_TSUBO = "format('{:.2f}', land_area_sqm / 3.30579::DOUBLE)::DOUBLE"


@query(
    "num02_tsubo",
    over("properties", sql=f"""SELECT id, {_TSUBO} AS tsubo, format('{{:.2f}}', {_TSUBO} * 3.30579::DOUBLE)::DOUBLE AS back,
 CAST(trunc(price_jpy / {_TSUBO}) AS BIGINT) AS per_tsubo,
 CASE WHEN land_area_sqm IS NOT NULL THEN concat(format('{{:.1f}}', land_area_sqm), 'm² (', format('{{:.1f}}', {_TSUBO}), '坪)') END AS label FROM properties"""),
)
def _tsubo(s):
    area = F.col("land_area_sqm")
    return s.properties.select(
        "id", N.sqm_to_tsubo(area).alias("tsubo"), N.tsubo_to_sqm(N.sqm_to_tsubo(area)).alias("back"),
        N.price_per_tsubo(F.col("price_jpy"), area).alias("per_tsubo"), N.area_label(area).alias("label"),
    )


@query(
    "num03_price_per_sqm",
    over("properties", sql="SELECT id, CASE WHEN price_jpy <> 0 AND land_area_sqm > 0 THEN price_jpy / land_area_sqm END AS price_per_sqm FROM properties"),
)
def _per_sqm(s):
    return s.properties.select("id", N.price_per_sqm(F.col("price_jpy"), F.col("land_area_sqm")).alias("price_per_sqm"))


@query(
    "num04_clamp",
    over("properties", sql="SELECT id, CASE WHEN land_area_sqm IS NOT NULL THEN greatest(0::DOUBLE, least(100::DOUBLE, land_area_sqm - 100)) END AS clamped FROM properties"),
)
def _clamp(s):
    return s.properties.select("id", N.clamp(F.col("land_area_sqm") - 100).alias("clamped"))


@query(
    "num05_score_band",
    D.scored("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN composite_score IS NULL THEN 'none' WHEN composite_score >= 70 THEN 'high'
 WHEN composite_score >= 40 THEN 'medium' ELSE 'low' END AS band FROM scored) GROUP BY band"""),
)
def _band(s):
    from proplytics.plans.market_queries import scored_properties

    return scored_properties(s).groupBy(N.score_band(F.col("composite_score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "num06_hazard_bands",
    over("hazard_assessments", sql="""SELECT pga_band, flood_band, count(*) AS n FROM (SELECT
 CASE WHEN pga IS NULL THEN 'none' WHEN pga < 0.1 THEN 'low' WHEN pga < 0.3 THEN 'moderate' WHEN pga < 0.6 THEN 'high' ELSE 'severe' END AS pga_band,
 CASE WHEN f IS NULL THEN 'none' WHEN f <= 0 THEN 'low' WHEN f < 0.5 THEN 'moderate' WHEN f < 3 THEN 'high' ELSE 'severe' END AS flood_band
 FROM (SELECT pga_475yr / 10::DOUBLE AS pga, flood_depth_max_m AS f FROM hazard_assessments)) GROUP BY pga_band, flood_band"""),
)
def _bands(s):
    return s.hazard_assessments.groupBy(
        N.pga_band(F.col("pga_475yr") / F.lit(10.0)).alias("pga_band"), N.flood_band(F.col("flood_depth_max_m")).alias("flood_band")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "num07_gross_profit",
    over("deals", sql="""SELECT id, c AS total_cost, t - c AS gross_profit,
 CASE WHEN c > 0 THEN (t - c)::DOUBLE / c * 100::DOUBLE ELSE 0::DOUBLE END AS margin_pct
FROM (SELECT id, coalesce(purchase_price, 0) + coalesce(renovation_budget, 0) AS c, coalesce(target_sale_price, 0) AS t FROM deals)"""),
)
def _profit(s):
    parts = deal_ops.profit(F.col("purchase_price"), F.col("renovation_budget"), F.col("target_sale_price"))
    return s.deals.select("id", *[c.alias(n) for n, c in parts.items()])


# --- dates ------------------------------------------------------------------


@query(
    "dt02_year_to_era",
    """SELECT o_orderkey, y AS year, CASE WHEN y >= 2019 THEN concat('令和', CAST(y - 2018 AS VARCHAR), '年') WHEN y >= 1989 THEN concat('平成', CAST(y - 1988 AS VARCHAR), '年')
 WHEN y >= 1926 THEN concat('昭和', CAST(y - 1925 AS VARCHAR), '年') WHEN y >= 1912 THEN concat('大正', CAST(y - 1911 AS VARCHAR), '年')
 WHEN y >= 1868 THEN concat('明治', CAST(y - 1867 AS VARCHAR), '年') ELSE concat(CAST(y AS VARCHAR), '年') END AS era
FROM (SELECT o_orderkey, CAST(1850 + o_custkey % 190 AS INT) AS y FROM orders)""",
)
def _to_era(s):
    y = (F.lit(1850) + F.col("o_custkey") % 190).cast("int")
    return s.orders.select("o_orderkey", y.alias("year")).withColumn("era", N.year_to_era(F.col("year")))


@query(
    "dt03_building_age",
    over("properties", sql="SELECT id, CASE WHEN year_built IS NOT NULL THEN greatest(0, 2026 - year_built) END AS age FROM properties"),
)
def _age(s):
    return s.properties.select("id", N.building_age(F.col("year_built")).alias("age"))


_CODES = ["wood", "steel_frame", "rc", "src", "light_steel", "brick"]


@query(
    "dt04_depreciation",
    over("properties", sql="""SELECT id, CASE WHEN year_built IS NOT NULL THEN greatest(0, CASE id % 6 WHEN 1 THEN 34 WHEN 2 THEN 47 WHEN 3 THEN 47 WHEN 4 THEN 27 ELSE 22 END - (2026 - year_built)) END AS remaining
FROM properties"""),
)
def _depreciation(s):
    kind = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("id") % 6 + 1).cast("int"))
    return s.properties.select(
        "id", N.depreciation_remaining(F.col("year_built"), kind).alias("remaining")
    )


@query(
    "dt06_iso_timestamp",
    over("properties", sql="SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM properties"),
)
def _iso(s):
    return s.properties.select("id", N.iso_timestamp(F.col("created_at")).alias("created"))
