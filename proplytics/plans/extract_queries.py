"""Queries: listings from pages, and crawl plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplytics.operators import extract
from proplytics.plans.registry import query
from proplytics.plans.twins import dim, over
from proplytics.session import materialise
from proplytics.sources.dimensions import dimension
from proplytics.sources.pages import raw_material


def details(s):
    return s.listing_html.select("page_id", F.col("source_id").alias("source"), "url", F.lit("detail").alias("kind"), "html")


def real_pages(s):
    """The landed pages, read as detail pages of the portals in turn."""
    source = F.element_at(F.array(*[F.lit(n) for n in extract.SOURCES]), (F.col("page_id") % 5 + 1).cast("int"))
    return s.pages.select("page_id", source.alias("source"), "url", F.lit("detail").alias("kind"), "html")


_SRC = "CASE page_id % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END"


@query(
    "src03_pages",
    """SELECT page_id, url, length(html) AS n_chars FROM pages""",
)
def _pages(s):
    return s.pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query(
    "ext01_page_links",
    """SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
)
def _links(s):
    raw = raw_material(real_pages(s), "links")
    return raw.select(
        "page_id", F.size("links").cast("bigint").alias("n_links"), F.array_join(F.transform("links", lambda a: a["href"]), " ").alias("hrefs")
    )


def _pair(label: str) -> str:
    return f"coalesce(nullif(regexp_extract(html, '<th>{label}</th><td>([^<]*)</td>', 1), ''), nullif(regexp_extract(html, '<dt>{label}</dt><dd>([^<]*)</dd>', 1), ''))"


@query(
    "ext01_label_values",
    over("listing_html", sql=f"SELECT page_id, {_pair('価格')} AS price, {_pair('土地面積')} AS land, {_pair('築年月')} AS built, {_pair('備考')} AS remarks FROM listing_html"),
)
def _pairs(s):
    raw = raw_material(details(s), "pairs")
    return raw.select("page_id", *[F.try_element_at("pairs", F.lit(k)).alias(n) for k, n in (("価格", "price"), ("土地面積", "land"), ("築年月", "built"), ("備考", "remarks"))])


_KEY = """CASE source WHEN 'akiya' THEN concat('akiya-', 1000000 + page_id) ELSE CAST(1000000 + page_id AS VARCHAR) END"""


@query(
    "ext05_details",
    over("listing_html", sql=f"""SELECT page_id, source_id AS source, {_KEY.replace('source ', 'source_id ')} AS source_id, '物件 ' || page_id AS title,
 CAST({_pair('価格').replace("([^<]*)", "(\\d+)万円")} AS BIGINT) * 10000 AS price, CAST(replace({_pair('土地面積')}, '㎡', '') AS DOUBLE) AS land_area_sqm,
 CAST(CASE page_id % 3 WHEN 0 THEN 1975 ELSE 2005 END AS INT) AS year_built, CASE page_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS rebuild_possible,
 CASE WHEN source_id IN ('akiya', 'bit') THEN 'https://cdn.example/photo' || (page_id % 10) || '.jpg' ELSE '' END AS images FROM listing_html"""),
)
def _details(s):
    names = ["page_id", "source", "source_id", "title", "price", "land_area_sqm", "year_built", "rebuild_possible"]
    rows = extract.extract_details(details(s), *names, "image_urls")
    return rows.select(*names, F.array_join("image_urls", " ").alias("images"))


_CARD_KEY = """CASE source WHEN 'suumo' THEN 'https://suumo.jp/chukoikkodate/nc_' || k || '/' WHEN 'homes' THEN '1' || k || '00000' WHEN 'athome' THEN '1' || k || '00000'
 WHEN 'akiya' THEN 'akiya-' || k ELSE 'B' || k END"""


@query(
    "ext02_cards",
    over("search_html", sql=f"""SELECT page_id, source, CAST(0 AS INT) AS card_no, {_CARD_KEY} AS source_id,
 CASE source WHEN 'bit' THEN '長野地裁松本支部 令和6年(ケ)第' || (o_orderkey % 900 + 1) || '号 長野県松本市' || k ELSE '中古一戸建て' || k END AS title,
 price_man * 10000 AS price, '長野県松本市' || k AS address, CASE WHEN source IN ('suumo', 'akiya', 'bit') THEN '20' END AS prefecture,
 CASE WHEN source <> 'bit' THEN area_int + 0.5::DOUBLE END AS land_area_sqm, CASE WHEN source <> 'bit' THEN '3LDK' END AS floor_plan,
 CASE WHEN source <> 'bit' THEN 1998::INT END AS year_built, CASE source WHEN 'akiya' THEN 'https://www.akiya-athome.jp/img/p' || k || '.jpg' ELSE '' END AS images
FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM search_html)
UNION ALL SELECT page_id, source, 1, 'https://suumo.jp/chukoikkodate/none/', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '' FROM search_html WHERE FALSE"""),
)
def _cards(s):
    rows = extract.extract_cards(s.search_html.select("page_id", "source", "url", "kind", "html"))
    return rows.select(
        "page_id", "source", "card_no", "source_id", "title", "price", "address", "prefecture", "land_area_sqm", "floor_plan", "year_built",
        F.array_join("image_urls", " ").alias("images"),
    )


@query(
    "ext14_next_page",
    f"""SELECT page_id, source, CASE WHEN source IN ('suumo', 'akiya', 'bit') THEN len(list_filter(texts, lambda t: t = '次へ' OR (source <> 'suumo' AND t IN ('次のページ', '次ページ', '>', '>>')) OR (source = 'akiya' AND t IN ('next', '›')))) > 0
 WHEN source = 'athome' THEN len(list_filter(texts, lambda t: contains(t, '次へ'))) > 0 ELSE FALSE END AS has_next
FROM (SELECT page_id, {_SRC} AS source, regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1) AS texts FROM pages)""",
)
def _next(s):
    return raw_material(real_pages(s), "links").select("page_id", "source", extract.has_next_page(F.col("source")).alias("has_next"))


_REQUESTS = """requests AS (SELECT DISTINCT lpad(CAST(c_custkey % 47 + 1 AS VARCHAR), 2, '0') AS prefecture_code, CAST(5000000 + c_nationkey * 1000000 AS BIGINT) AS price_max,
 CASE WHEN c_nationkey % 3 = 0 THEN CAST(1000000 AS BIGINT) END AS price_min, CASE c_nationkey % 4 WHEN 0 THEN 'land' WHEN 1 THEN 'condo' WHEN 2 THEN 'detached_house' END AS property_type,
 CASE WHEN c_nationkey % 2 = 0 THEN lpad(CAST(c_custkey % 47 + 1 AS VARCHAR), 2, '0') || '101' END AS town FROM customer),
codes AS (SELECT p.code, lower(p.name_en) AS slug, CASE WHEN p.code = '01' THEN '010' WHEN p.code < '08' THEN '020' WHEN p.code < '15' THEN '030' WHEN p.code < '21' THEN '040' WHEN p.code < '24' THEN '050'
 WHEN p.code < '31' THEN '060' WHEN p.code < '36' THEN '070' WHEN p.code < '40' THEN '080' ELSE '090' END AS region,
 CASE WHEN p.code = '01' THEN 'sapporo' WHEN p.code < '08' THEN 'sendai' WHEN p.code = '14' THEN 'yokohama' WHEN p.code < '16' OR p.code IN ('19', '20') THEN 'tokyo' WHEN p.code < '25' THEN 'nagoya' WHEN p.code = '28' THEN 'kobe'
 WHEN p.code < '31' THEN 'osaka' WHEN p.code < '36' THEN 'hiroshima' WHEN p.code < '40' THEN 'takamatsu' ELSE 'fukuoka' END AS court FROM prefectures p),
wide AS (SELECT r.*, c.*, p AS page, price_max // 10000 AS man, CASE property_type WHEN 'land' THEN '20' WHEN 'condo' THEN '30' ELSE '10' END AS kind,
 list_min(list_filter([50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 1000, 1500, 2000, 3000, 5000], lambda s: s >= price_max // 10000)) AS step
 FROM requests r JOIN codes c ON c.code = r.prefecture_code CROSS JOIN (SELECT unnest(range(1, 6))::INT AS p))"""


def _crawl_requests(s, *sources):
    code = F.lpad((F.col("c_custkey") % 47 + 1).cast("string"), 2, "0")
    n = F.col("c_nationkey")
    kind = F.when(n % 4 == 0, "land").when(n % 4 == 1, "condo").when(n % 4 == 2, "detached_house")
    base = s.customer.select(
        code.alias("prefecture_code"), (F.lit(5_000_000) + n * 1_000_000).cast("bigint").alias("price_max"), F.when(n % 3 == 0, F.lit(1_000_000)).cast("bigint").alias("price_min"),
        kind.alias("property_type"), F.when(n % 2 == 0, F.array(F.concat(code, F.lit("101")))).alias("municipality_codes")).distinct()
    return base.withColumn("source", F.explode(F.array(*map(F.lit, sources))))


@query(
    "ext16_crawl_urls",
    f"""WITH {dim('prefectures')}, {_REQUESTS} SELECT source, prefecture_code, price_max, page, CASE source
 WHEN 'suumo' THEN 'https://suumo.jp/jj/bukken/ichiran/JJ012FC001/?ar=' || region || '&bs=021&ta=' || code || '&pc=' || step || '&po=2&page=' || page
 WHEN 'homes' THEN 'https://www.homes.co.jp/kodate/chu/' || slug || '/list/?page=' || page || '&price_max=' || man
 WHEN 'athome' THEN 'https://www.athome.co.jp/kodate/chuko/' || slug || '/list/?price_to=' || man || '&page=' || page
 WHEN 'akiya' THEN 'https://www.akiya-athome.jp/bukken/search/list/?search_type=area&br_kbn=buy&sbt_kbn=house&pref_cd=' || code || coalesce('&gyosei_cd[]=' || town, '')
  || '&item_count=100&search_sort=kokai_date' || CASE WHEN page > 1 THEN '&page=' || page ELSE '' END
 WHEN 'bit' THEN 'https://www.bit.courts.go.jp/app/list/pt001/h01?bpiKubun=' || kind || '&courtAreaId=' || court || '&kenCode=' || code || coalesce('&priceFrom=' || price_min, '')
  || '&priceTo=' || price_max || '&page=' || page || '&sort=new' END AS url
FROM wide CROSS JOIN (SELECT unnest(['suumo', 'homes', 'athome', 'akiya', 'bit', 'other']) AS source)""",
)
def _urls(s):
    """All registered portals and one that is not."""
    rows = extract.crawl_urls(_crawl_requests(s, *extract.SOURCES, "other"), max_pages=5)
    return rows.select("source", "prefecture_code", "price_max", "page", "url")


@query(
    "ext16_crawl_forms",
    f"""WITH {dim('prefectures')}, {_REQUESTS} SELECT prefecture_code, page, kind, court, CAST(price_min AS VARCHAR) AS price_from, CAST(price_max AS VARCHAR) AS price_to, 6 + (price_min IS NOT NULL)::INT AS fields FROM wide""",
)
def _forms(s):
    """The court search as a form."""
    rows = extract.crawl_forms(_crawl_requests(s, "bit"), max_pages=5)
    value = {k: F.try_element_at("form", F.lit(k)) for k in ("bpiKubun", "courtAreaId", "priceFrom", "priceTo")}
    return rows.select(
        "prefecture_code", "page", value["bpiKubun"].alias("kind"), value["courtAreaId"].alias("court"), value["priceFrom"].alias("price_from"), value["priceTo"].alias("price_to"),
        F.size("form").alias("fields"))


@query(
    "reg01_portals",
    f"""WITH {dim('scrape_sources')}, feed AS (SELECT CASE l_linenumber WHEN 1 THEN 'suumo' WHEN 2 THEN 'homes' WHEN 3 THEN 'athome' WHEN 4 THEN 'akiya' WHEN 5 THEN 'other' END AS source FROM lineitem),
counts AS (SELECT source, count(*) AS n FROM feed GROUP BY source)
SELECT coalesce(c.source, p.id) AS source, p.display_name, p.id IS NOT NULL AS is_registered, coalesce(n, 0) AS n FROM counts c FULL JOIN scrape_sources p ON p.id = c.source""",
)
def _portals(s):
    """Registered portals beside the sources that a feed names: one without rows, one that nobody registered, one without a name."""
    n = F.col("l_linenumber")
    feed = s.lineitem.select(F.when(n == 1, "suumo").when(n == 2, "homes").when(n == 3, "athome").when(n == 4, "akiya").when(n == 5, "other").alias("source"))
    return extract.registered(feed)


@query(
    "jn17_portal_codes",
    f"""WITH {dim('prefectures')} SELECT p.code, count(o.o_orderkey) AS n, CASE WHEN p.code = '01' THEN '010' WHEN p.code < '08' THEN '020' WHEN p.code < '15' THEN '030' WHEN p.code < '21' THEN '040' WHEN p.code < '24' THEN '050'
 WHEN p.code < '31' THEN '060' WHEN p.code < '36' THEN '070' WHEN p.code < '40' THEN '080' ELSE '090' END AS region_code,
 CASE WHEN p.code = '01' THEN 'sapporo' WHEN p.code < '08' THEN 'sendai' WHEN p.code = '14' THEN 'yokohama' WHEN p.code < '16' OR p.code IN ('19', '20') THEN 'tokyo' WHEN p.code < '25' THEN 'nagoya' WHEN p.code = '28' THEN 'kobe'
 WHEN p.code < '31' THEN 'osaka' WHEN p.code < '36' THEN 'hiroshima' WHEN p.code < '40' THEN 'takamatsu' ELSE 'fukuoka' END AS court, lower(p.name_en) AS slug
FROM prefectures p JOIN orders o ON lpad(CAST(o.o_custkey % 47 + 1 AS VARCHAR), 2, '0') = p.code GROUP BY ALL""",
)
def _codes(s):
    counts = s.properties.groupBy(F.col("prefecture_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    side = dimension(s.spark, "prefectures").select("code", F.lower("name_en").alias("slug"))
    return counts.join(side, "code").select(
        "code", "n", extract.region_code(F.col("code")).alias("region_code"), extract.court_district(F.col("code")).alias("court"), "slug"
    )


@query(
    "ext16_price_step",
    """SELECT o_orderkey, CAST(coalesce(list_min(list_filter([50, 100, 150, 200, 300, 400, 500, 600, 700, 800, 1000, 1500, 2000, 3000, 5000], lambda s: s >= price // 10000)), 5000) AS INT) AS step
FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 60::DOUBLE) AS BIGINT) AS price FROM orders)""",
)
def _step(s):
    return s.properties.select(F.col("id").alias("o_orderkey"), extract.price_step(F.col("price_jpy")).alias("step"))


@query(
    "jn18_prefer_details",
    over("search_html", "listing_html", sql="""SELECT s.source, count(*) AS n, count(*) FILTER (l.page_id IS NOT NULL) AS from_detail,
 CAST(sum(CASE WHEN l.page_id IS NOT NULL THEN (s.price_man - 1) ELSE s.price_man END) AS BIGINT) AS man FROM search_html s
 LEFT JOIN (SELECT DISTINCT l_orderkey AS page_id FROM lineitem WHERE l_returnflag = 'A') l ON l.page_id = s.page_id GROUP BY s.source"""),
)
def _prefer(s):
    """Detail rows replace the card wherever the crawl reached them (here: orders with a returned line)."""
    # cards are needed twice and pages take long to read; of either page only what is summed is made
    cards = materialise(extract.extract_cards(s.search_html.select("page_id", "source", "url", "kind", "html"), "page_id", "source", "source_url", "price"))
    reached = s.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("page_id")).distinct()
    known = cards.select("page_id", "source_url")
    read = extract.extract_details(details(s), "page_id", "source", "price").join(reached, "page_id").join(known, "page_id")
    rows = extract.prefer_details(cards, read)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("from_detail").alias("from_detail"), F.sum((F.col("price") / 10_000).cast("bigint")).alias("man")
    )


# --- what only some portals embed -------------------------------------------------


def rich(s):
    return s.rich_html.select("page_id", "source", "url", "kind", "html")


@query(
    "ext03_source_ids",
    over("rich_html", sql="SELECT page_id, source, CASE source WHEN 'suumo' THEN 'ab' || k WHEN 'athome' THEN CAST(page_id + 100000 AS VARCHAR) WHEN 'akiya' THEN 'akiya-' || k ELSE k END AS source_id FROM rich_html"),
)
def _ids(s):
    rows, key = s.rich_html.select("page_id", "source", "url"), None
    for source in extract.SOURCES:
        value = extract.source_key(source, F.col("url"))
        key = F.when(F.col("source") == source, value) if key is None else key.when(F.col("source") == source, value)
    return rows.select("page_id", "source", key.alias("source_id"))


@query(
    "ext04_absolute_urls",
    """SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: CASE WHEN starts_with(h, '//') THEN 'https:' || h
 WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN 'https://suumo.jp' || h ELSE 'https://suumo.jp/' || h END), ' ') AS hrefs FROM pages""",
)
def _absolute(s):
    raw = raw_material(real_pages(s), "links")
    return raw.select("page_id", F.array_join(F.transform("links", lambda a: extract.absolute_url(a["href"], extract.BASE_URL["suumo"])), " ").alias("hrefs"))


@query(
    "ext06_card_areas",
    over("search_html", sql="SELECT source, count(*) AS n, sum(CASE WHEN source <> 'bit' THEN area_int + 0.5::DOUBLE END) AS land, count(*) FILTER (source <> 'bit') AS plans FROM search_html GROUP BY source"),
)
def _areas(s):
    rows = extract.extract_cards(s.search_html.select("page_id", "source", "url", "kind", "html"), "source", "land_area_sqm", "floor_plan")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("land_area_sqm").alias("land"), F.count("floor_plan").alias("plans"))


@query(
    "ext08_rebuild_flag",
    over("listing_html", sql="SELECT source_id AS source, CASE page_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS rebuild_possible, count(*) AS n FROM listing_html GROUP BY ALL"),
)
def _rebuild(s):
    return extract.extract_details(details(s), "source", "rebuild_possible").groupBy("source", "rebuild_possible").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ext09_embedded_values",
    over("rich_html", sql="""SELECT page_id, source, CASE source WHEN 'athome' THEN NULL ELSE CAST(man AS BIGINT) * 10000 END AS price,
 CASE source WHEN 'homes' THEN '長野県松本市中央' || k WHEN 'suumo' THEN '東京都新宿区西新宿' || k ELSE '長野県松本市' || k END AS address, CASE source WHEN 'homes' THEN 2 WHEN 'athome' THEN 2 END::INT AS floors,
 CASE source WHEN 'homes' THEN FALSE WHEN 'athome' THEN TRUE END AS rebuild_possible, CASE source WHEN 'suumo' THEN '13' ELSE '20' END AS prefecture FROM rich_html"""),
)
def _embedded(s):
    return extract.extract_details(rich(s), "page_id", "source", "price", "address", "floors", "rebuild_possible", "prefecture")


@query(
    "ext10_coordinates",
    over("rich_html", sql="""SELECT page_id, source, CASE WHEN source <> 'suumo' THEN CAST('36.' || tail AS DOUBLE) END AS latitude,
 CASE source WHEN 'homes' THEN 137.5::DOUBLE WHEN 'athome' THEN 138.25 WHEN 'akiya' THEN 138.5 END AS longitude FROM (SELECT page_id, CASE WHEN source = 'bit' THEN 'suumo' ELSE source END AS s2, source AS real, tail FROM rich_html) r(page_id, source, real, tail)""").replace(
        "SELECT page_id, source, CASE WHEN source", "SELECT page_id, real AS source, CASE WHEN source"),
)
def _points(s):
    return extract.extract_details(rich(s), "page_id", "source", "latitude", "longitude")


@query(
    "ext11_images",
    over("rich_html", sql="""SELECT page_id, source, CASE source WHEN 'suumo' THEN 'https://img.suumo.jp/a' || k || '.jpg' WHEN 'homes' THEN 'https://x/' || k || '.jpg'
 WHEN 'athome' THEN 'https://img.athome.co.jp/' || k || '.jpg https://bg/' || k || '.png' WHEN 'akiya' THEN 'https://c/' || k || '.jpg https://c/t.jpg' ELSE 'https://www.bit.courts.go.jp/img/' || k || '.jpg' END AS images FROM rich_html"""),
)
def _images(s):
    return extract.extract_details(rich(s), "page_id", "source", "image_urls").select("page_id", "source", F.array_join("image_urls", " ").alias("images"))


@query(
    "ext12_auction_fields",
    over("rich_html", sql="""SELECT page_id, '令和6年(ケ)第' || (page_id % 900 + 1) || '号' AS case_number, '長野地裁' AS court_name, 'https://www.bit.courts.go.jp/pdf/' || k || '.pdf' AS pdf,
 '物件明細書' AS label FROM rich_html WHERE source = 'bit'"""),
)
def _auction(s):
    pages = rich(s).where("source = 'bit'")
    rows = extract.details_of("bit", raw_material(pages, *extract.DETAIL_FIELDS["bit"]))
    return rows.select("page_id", "case_number", "court_name", F.explode("pdfs").alias("d")).select(
        "page_id", "case_number", "court_name", F.col("d.url").alias("pdf"), "d.label"
    )


@query(
    "ext13_auction_price",
    over("search_html", sql="SELECT page_id, price_man * 10000 AS price FROM search_html WHERE source = 'bit'"),
)
def _auction_price(s):
    pages = s.search_html.where("source = 'bit'").select("page_id", "source", "url", "kind", "html")
    return extract.cards_of("bit", raw_material(pages, *extract.CARD_FIELDS["bit"])).select("page_id", "price")


@query(
    "ext15_area_codes",
    over("rich_html", sql="SELECT code, count(*) AS n FROM (SELECT unnest(['20202', '2' || tail]) AS code FROM rich_html WHERE source = 'akiya') GROUP BY code"),
)
def _area_codes(s):
    raw = raw_material(rich(s).where("source = 'akiya'"), "inputs")
    return raw.select(F.explode("inputs").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@query(
    "srt06_capped_links",
    f"""SELECT page_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 10), ' ') AS hrefs FROM (SELECT page_id, {_HREFS} AS l FROM pages)""",
)
def _capped(s):
    from proplytics.functions.text import distinct_capped

    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return s.pages.select("page_id", F.array_join(distinct_capped(found, 10), " ").alias("hrefs"))


@query(
    "set05_distinct_links",
    f"""SELECT page_id, len(list_distinct(l)) AS n, len(l) AS total FROM (SELECT page_id, {_HREFS} AS l FROM pages)""",
)
def _distinct(s):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return s.pages.select("page_id", F.size(F.array_distinct(found)).cast("bigint").alias("n"), F.size(found).cast("bigint").alias("total"))


@query(
    "set06_merged_pairs",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN nullif(o_orderpriority, '') ELSE nullif(o_orderstatus, '') END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS b, o_orderpriority AS c FROM orders""",
)
def _merged(s):
    from proplytics.functions.text import merge_pairs

    key = F.col("o_orderkey")
    first = F.create_map(F.lit("a"), F.col("o_orderstatus"), F.lit("b"), F.when(key % 2 == 0, F.col("o_orderstatus")).otherwise(""))
    second = F.create_map(F.lit("a"), F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise(""), F.lit("c"), F.col("o_orderpriority"))
    rows = s.orders.select("o_orderkey", merge_pairs(first, second).alias("m"))
    return rows.select("o_orderkey", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("a", "b", "c")])


@query(
    "ext07_card_texts",
    over("search_html", sql="""SELECT source, count(*) AS n, count(DISTINCT page_id) AS addresses, CAST(sum(price_man) AS BIGINT) AS man FROM search_html GROUP BY source"""),
)
def _texts(s):
    rows = extract.extract_cards(s.search_html.select("page_id", "source", "url", "kind", "html"), "source", "title", "address", "price")
    return rows.groupBy("source").agg(
        F.count("title").alias("n"), F.countDistinct("address").alias("addresses"), F.sum((F.col("price") / 10_000).cast("bigint")).alias("man")
    )
