"""Cases that registered queries do not reach: nulls, long texts, repeated and unknown inputs."""

from pyspark.sql import functions as F

from proplytics.functions import numbers as N
from proplytics.operators import crawlops, enrich, extract, finance, hazard, score, search
from proplytics.sources import dimensions, feeds


def test_null_stays_null(spark):
    row = spark.range(1).select(
        N.clamp(F.lit(None).cast("double")).alias("a"), N.clamp(F.lit(120.0)).alias("b"),
        N.depreciation_remaining(F.lit(None).cast("int"), F.lit("rc")).alias("c"), N.depreciation_remaining(F.lit(2000), F.lit("rc")).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (None, 100.0, None, 21)


def test_gains_without_a_price(spark):
    rows = spark.createDataFrame([(1, 9_000_000, 5_000_000, 330_000, 12), (2, None, 5_000_000, 330_000, 12)], "id int, sale_price long, acquisition_cost long, sale_costs long, holding_months int")
    got = {r.id: r for r in finance.with_capital_gains(rows).collect()}
    assert got[1].taxable_gain == 3_670_000 and got[1].tax_rate == 0.3963
    assert (got[2].taxable_gain, got[2].tax_rate, got[2].tax_amount, got[2].net_after_tax) == (None,) * 4


def test_region_of_codes_outside_the_table(spark):
    rows = spark.createDataFrame([("01",), ("13",), ("47",), ("99",), ("00",), (None,)], "c string")
    got = [tuple(r) for r in rows.select(extract.region_code(F.col("c")), extract.court_district(F.col("c"))).collect()]
    assert got == [("010", "sapporo"), ("030", "tokyo"), ("090", "fukuoka"), ("030", None), ("030", None), ("030", None)]
    assert [p[0] for p in dimensions.PREFECTURES] == [f"{i:02d}" for i in range(1, 48)]


def test_long_texts_are_translated_to_the_end(spark):
    head, tail = "あ" * 5000, "終わり"
    rows = spark.createDataFrame([(1, head + tail), (2, head + "別"), (3, " "), (4, None), (5, head + tail)], "id int, text string")
    memory = spark.createDataFrame([(head, "H"), (tail, "end")], "text string, translated string")
    got = {r.id: r.translated for r in enrich.translate(rows, memory).collect()}
    assert got == {1: "Hend", 2: "H別", 3: " ", 4: None, 5: "Hend"}
    calls = enrich.api_batches(rows, "id").orderBy("batch", "position").collect()
    assert [(r.id, r.piece, r.position, r.text) for r in calls] == [(1, 0, 0, head), (1, 1, 1, tail), (2, 0, 2, head), (2, 1, 3, "別"), (5, 0, 4, head), (5, 1, 5, tail)]


def test_a_detail_replaces_the_whole_card(spark):
    cards = spark.createDataFrame([(1, "u1", 100, "card"), (2, "u2", 200, "card")], "page_id long, source_url string, price long, title string")
    details = spark.createDataFrame([(7, "u1", 90, 35.5), (9, "u1", 80, 36.5), (8, "u3", 1, 1.0)], "page_id long, source_url string, price long, latitude double")
    got = {r.source_url: r for r in extract.prefer_details(cards, details).collect()}
    assert set(got) == {"u1", "u2"}
    assert (got["u1"].page_id, got["u1"].price, got["u1"].latitude, got["u1"].title, got["u1"].from_detail) == (9, 80, 36.5, None, True)
    assert (got["u2"].price, got["u2"].latitude, got["u2"].title, got["u2"].from_detail) == (200, None, "card", False)


def test_the_latest_hazard_response_counts(spark):
    body = '{"features": [{"properties": {"T50_P05_BV_SI": %s, "BV": %s}}]}'
    rows = [(1, "avghazard", body % (1, 1), "2024-01-02 00:00:00"), (1, "avghazard", body % (2, 2), "2024-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "property_id long, kind string, body string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
    one, two = (hazard.responses_by_property(f).collect() for f in (frame, frame.orderBy("fetched_at")))
    assert one == two and len(one) == 1
    alone = hazard.responses_by_property(frame.limit(1)).first()
    assert one[0].pga_475yr == alone.pga_475yr


def test_unknown_tile_layers_are_kept_apart(spark):
    files = spark.createDataFrame([(f"/t/{feeds.TILE_LAYERS[0]}/14/1/2.pbf", 5), ("/t/nonsense/14/1/2.pbf", 5)], "path string, length long")
    assert [r.layer for r in feeds.tile_presence(files).collect()] == [feeds.TILE_LAYERS[0]]
    assert [r.path for r in feeds.unknown_tiles(files).collect()] == ["/t/nonsense/14/1/2.pbf"]


def test_rates_by_bracket(spark):
    rows = spark.createDataFrame([(0,), (2_000_000,), (2_000_001,), (4_000_001,), (None,)], "price long")
    got = finance.with_rate(rows, "brokerage", "price", {"rate": "rate"}).collect()
    assert {r.price: r.rate for r in got} == {0: 0.05, 2_000_000: 0.05, 2_000_001: 0.04, 4_000_001: 0.03, None: None}


def test_slots_and_latest_scores(spark):
    due = spark.createDataFrame([("a", f"{i:02d}", 2) for i in range(1, 6)], "source_id string, prefecture_code string, slots int")
    assert sorted(r.prefecture_code for r in crawlops.within_slots(due).collect()) == ["01", "02"]
    scores = spark.createDataFrame([(1, 1, 5.0), (1, 3, 2.0), (1, 3, 4.0), (2, 9, 1.0)], "property_id long, version int, composite double")
    assert {(r.property_id, r.version, r.composite) for r in score.latest_scores(scores).collect()} == {(1, 3, 4.0), (2, 9, 1.0)}


def test_scored_properties_are_one_join(spark):
    from proplytics.plans.market_queries import scored_properties
    from proplytics.plans.registry import Source

    plan = scored_properties(Source(spark, "/root/testdata/sf0.001")).explain
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        plan()
    assert out.getvalue().count("Join") <= 2 and search.page_count is not None
