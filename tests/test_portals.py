"""Portals as rows, and values in bands, against loops."""

import random

from pyspark.sql import functions as F

from proplytics.operators import extract, finance, ranges


def test_a_new_portal_needs_a_row_only(spark):
    portals = spark.createDataFrame([("new", "https://new.example/{slug}/", "a={prefecture}&from={price_min}&fixed=1&p={later_page}")], "source string, path string, query string")
    requests = spark.createDataFrame([("new", "13", 5), ("new", "13", None), ("gone", "13", 5), ("new", None, None)], "source string, prefecture_code string, price_min long")
    got = {(r.source, r.prefecture_code, r.price_min, r.page): r.url for r in extract.crawl_urls(requests, 2, portals).collect()}
    assert len(got) == 8
    assert got["new", "13", 5, 1] == "https://new.example/tokyo/?a=13&from=5&fixed=1"
    assert got["new", "13", None, 2] == "https://new.example/tokyo/?a=13&fixed=1&p=2"
    assert got["gone", "13", 5, 1] is None
    assert got["new", None, None, 1] == "https://new.example//?fixed=1"


def test_several_towns_of_one_request(spark):
    requests = spark.createDataFrame([("akiya", "13", ["13308", "13361"]), ("akiya", "13", [])], "source string, prefecture_code string, municipality_codes array<string>")
    urls = sorted(r.url for r in extract.crawl_urls(requests, 1).collect())
    head, tail = "https://www.akiya-athome.jp/bukken/search/list/?search_type=area&br_kbn=buy&sbt_kbn=house&pref_cd=13", "&item_count=100&search_sort=kokai_date"
    assert urls == sorted([head + "&gyosei_cd[]=13308&gyosei_cd[]=13361" + tail, head + tail])


def test_bands_hold_what_a_loop_finds(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, -3.5, 0.0, 1e9, 17_000_000.5, rnd.randrange(0, 4000) / 4])) for i in range(400)]
    edge = lambda: rnd.choice([None, -10, 0, 20_000_000, rnd.randrange(0, 1000)])
    bands = [(k, rnd.choice(["a", "b", None]), edge(), edge()) for k in range(150)]
    got = ranges.band_join(spark.createDataFrame(rows, "id int, kind string, x double"), spark.createDataFrame(bands, "band int, kind string, lo long, hi long"), "x", "lo", "hi", ["kind"])
    want = set()
    for i, kind, x in rows:
        met = [k for k, other, lo, hi in bands if kind is not None and kind == other and x is not None and (lo is None or x >= lo) and (hi is None or x < hi)]
        want |= {(i, k) for k in met or [None]}
    found = [(r.id, r.band) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_renovation_of_odd_houses(spark):
    houses = spark.createDataFrame(
        [(1, 100.0, 2020, "木造", None), (2, 100.0, 1960, "鉄筋コンクリート造", True), (3, 100.0, 1960, None, None), (4, 50.0, None, "軽量鉄骨造", True), (5, None, 1960, "木造", True), (6, -1.0, 1960, "木造", True), (7, 900.0, 2020, "木造", True), (8, float("nan"), 2020, "木造", True)],
        "id int, building_area_sqm double, year_built int, structure string, rebuild_possible boolean")
    rows = finance.renovation_estimate(houses, 2026)
    got = {r.id: (r.work, r.least, r.most) for r in rows.where(F.col("is_advised")).collect()}
    assert got == {1: ("basic", 2_000_000, 4_000_000), 2: ("rebuild", 21_000_000, 35_000_000), 3: ("full", 5_000_000, 10_000_000), 4: ("full", 5_500_000, 11_000_000), 7: ("basic", 6_000_000, 12_000_000)}
    assert sorted((r.id, r.work) for r in rows.where("work IS NULL").collect()) == [(5, None), (6, None), (8, None)]
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_forms_hold_what_addresses_do(spark):
    requests = spark.createDataFrame([("akiya", "13", ["13308", "13361"]), ("bit", "13", None), ("gone", "13", None)], "source string, prefecture_code string, municipality_codes array<string>")
    got = {r.source: r.form for r in extract.crawl_forms(requests, 1).collect()}
    assert got["akiya"]["gyosei_cd[]"] == "13308&gyosei_cd[]=13361"
    assert got["bit"] == {"bpiKubun": "10", "courtAreaId": "tokyo", "kenCode": "13", "page": "1", "sort": "new"}
    assert got["gone"] is None
