"""Joins, upserts and streams against brute force on small data."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from proplytics.operators import enrich, ingest, match
from proplytics.sources import schemas
from proplytics.streaming import jobs


def bigrams(s):
    return {s[i : i + 2] for i in range(len(s) - 1)} if len(s) >= 2 else {s}


def jaccard(a, b):
    x, y = bigrams(a), bigrams(b)
    return 1.0 if a == b else len(x & y) / len(x | y)


def test_similar_texts_is_exact(spark):
    rng = random.Random(7)
    texts = set()
    for _ in range(40):
        base = "".join(rng.choice("東西南北中央町市区一二三123-") for _ in range(rng.randint(1, 60)))
        texts.add(base)
        for _ in range(4):
            chars = list(base)
            for _ in range(rng.randint(1, 3)):
                chars[rng.randrange(len(chars))] = rng.choice("東西4567甲乙")
            texts.add("".join(chars) + rng.choice(["", "9", "10"]))
    texts = sorted(texts)
    rows = spark.createDataFrame([(t,) for t in texts], "address_normalized string")
    got = {(r.l, r.r): r.score for r in match.similar_texts(rows, rows).collect()}
    want = {(a, b): jaccard(a, b) for a in texts for b in texts if jaccard(a, b) >= 0.85}
    assert got == pytest.approx(want)
    assert len(want) > len(texts)


def meters(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("hot_cell", [256, 3, 0])
def test_first_within_is_exact(spark, hot_cell):
    """A third of the points crowd into one spot; every crowding threshold gives the same answer."""
    rng = random.Random(11)
    spot = lambda: (35.0 + rng.random() * 0.0012, 139.0 + rng.random() * 0.0012)
    wide = lambda: (35.0 + rng.random() * 0.02, 139.0 + rng.random() * 0.02)
    store = [(i, *(spot() if i % 3 == 0 else wide())) for i in range(900)] + [(5000 + i, 35.0005, 139.0005) for i in range(50)]
    asked = [(i, *(spot() if i % 3 == 0 else wide())) for i in range(300)]
    got = {
        r.key: r.match_id
        for r in match.first_within(
            spark.createDataFrame(asked, "key int, lat double, lng double"),
            spark.createDataFrame(store, "id int, lat double, lng double"),
            hot_cell=hot_cell,
        ).collect()
    }
    want = {}
    for key, lat, lng in asked:
        hits = [i for i, y, x in store if abs(y - lat) <= 0.0005 and abs(x - lng) <= 0.0005 and meters((lat, lng), (y, x)) <= 50]
        if hits:
            want[key] = min(hits)
    assert got == want and len(want) > 100


def test_dense_ordinals_over_sparse_keys(spark):
    rng = random.Random(3)
    keys = sorted({rng.randint(-(2**62), 2**62) for _ in range(200)} | set(range(70_000, 70_300)) | {0, 65535, 65536})
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.ordinal for r in enrich.dense_ordinals(rows, "k").collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_pointer_chains_are_followed(spark):
    n = 40
    rows = spark.createDataFrame([(f"k{i}", f"k{max(0, i - 1)}") for i in range(n)], "key string, parent string")
    assert {r.root for r in ingest.follow(rows).collect()} == {"k0"}


BASE = {f.strip().rsplit(" ", 1)[0]: None for f in schemas.LISTING.replace("map<string,string>", "map").split(",")}


def listing(i, day, **values):
    row = dict(BASE, source="homes", source_id=str(i), source_url=f"https://x/{i}", image_urls=[f"u{i}"], raw_data={"n": str(i)},
               scraped_at=dt.datetime(2026, 1, day))
    row.update(values)
    return row


def frames(spark):
    feed = spark.createDataFrame([], schemas.LISTING)
    return feed, spark.createDataFrame([], schemas.PROPERTY_LISTINGS), spark.createDataFrame([], schemas.PROPERTIES)


def as_of():
    return F.lit("2026-02-01 00:00:00").cast("timestamp_ntz")


def test_upsert_merges_and_is_idempotent(spark):
    empty, listings, properties = frames(spark)
    rows = [
        listing(1, 1, address="中央1-2-3", price=100, land_area_sqm=50.0),
        listing(1, 2, address="中央1-2-3", price=None, floor_plan=""),
        listing(2, 1, address="中央1-2-3", price=300),
        listing(3, 1, address="Unknown"),
        listing(4, 1, address=None, price=0, latitude=35.0, longitude=None),
    ]
    feed = spark.createDataFrame(rows, empty.schema)
    one = ingest.upsert(feed, listings, properties, as_of())
    got = {r.id: r for r in one.properties.collect()}
    assert set(got) == {"homes:1", "homes:3", "homes:4"}
    # listing 1 seen last on day 2 without a price, listing 2 on day 1: the price of day 1 order decides
    assert got["homes:1"].price_jpy in (100, 300) and got["homes:1"].land_area_sqm == 50.0
    assert got["homes:3"].address_ja == "Unknown" and got["homes:4"].lat is None and got["homes:4"].price_jpy == 0
    new = {r.source_id: r.is_new for r in one.outcomes.collect()}
    assert new == {"1": True, "2": False, "3": True, "4": True}
    assert one.images.count() == 4 and one.scores.count() == 3
    two = ingest.upsert(feed, one.listings, one.properties, as_of())
    strip = lambda s: sorted(s.properties.drop("updated_at").collect(), key=lambda r: r.id)
    assert strip(two) == strip(one)
    assert two.outcomes.where("is_new").count() == 0 and two.images.count() == 0
    assert two.listings.count() == one.listings.count() == 4


def test_tiers_resolve_a_batch_against_itself(spark):
    empty, listings, _ = frames(spark)
    stored = spark.createDataFrame(
        [("P1", "長野県松本市中央1-2-3", "長野県松本市中央1-2-3", 36.0, 138.0)], "id string, address_ja string, address_normalized string, lat double, lng double"
    )
    rows = [
        listing(1, 1, address="長野県松本市中央一丁目２番３号", municipality="松本市"),
        listing(2, 1, address="岐阜県高山市丹生川町坊方字西洞山甲2000-1", municipality="高山市", latitude=36.5, longitude=137.2),
        listing(3, 2, address="岐阜県高山市丹生川町坊方字西洞山甲2000-12", municipality="高山市"),
        listing(4, 3, address="別の住所", latitude=36.5001, longitude=137.2001),
        listing(5, 4, address="岐阜県高山市丹生川町坊方字西洞山甲２０００－１", municipality="高山市"),
        listing(6, 5, address=None, latitude=36.00001, longitude=138.00001),
        listing(7, 6, address=None),
    ]
    batch = ingest.fold_listings(spark.createDataFrame(rows, empty.schema))
    got = {r.source_id: (r.property_id, r.is_new) for r in ingest.resolve_by_tiers(batch, listings, stored).collect()}
    assert got == {
        "1": ("P1", False), "2": ("homes:2", True), "3": ("homes:2", False), "4": ("homes:2", False), "5": ("homes:2", False),
        "6": ("P1", False), "7": ("homes:7", True),
    }


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    empty, listings, properties = frames(spark)
    days = [
        [listing(i, 1, address=f"中央{i % 4}-1", price=1000 + i) for i in range(12)],
        [listing(i, 2, address=f"中央{i % 4}-1", price=2000 + i) for i in range(6, 18)] + [listing(99, 2, source="other")],
    ]
    feed_dir = str(tmp_path / "feed")
    for part in days:
        spark.createDataFrame(part, empty.schema).coalesce(1).write.mode("append").parquet(feed_dir)
    store = jobs.run_feed_upsert(spark, feed_dir, str(tmp_path / "store"), str(tmp_path / "ckpt"), files_per_batch=1)
    batch = [row for part in days for row in part if row["source"] != "other"]
    whole = ingest.upsert(spark.createDataFrame(batch, empty.schema), listings, properties, as_of())
    key = lambda r: (r.source_id, r.source_listing_id)
    got = {key(r): (r.property_id, r.listing_status, r.last_scraped_at) for r in store.latest("listings").collect()}
    assert got == {key(r): (r.property_id, r.listing_status, r.last_scraped_at) for r in whole.listings.collect()}
    prices = lambda df: {r.id: r.price_jpy for r in df.select("id", "price_jpy").collect()}
    assert prices(store.latest("properties")) == prices(whole.properties)
    stubs = {r.property_id: r.assessed_at for r in store.latest("hazards").collect()}
    assert set(stubs) == {r.property_id for r in whole.hazards.collect()} and None not in stubs.values()
    assert store.log("quarantine").count() == 1
    before = prices(store.latest("properties"))
    jobs.run_feed_upsert(spark, feed_dir, str(tmp_path / "store"), str(tmp_path / "ckpt"))
    assert prices(store.latest("properties")) == before
    assert prices(store.compact(str(tmp_path / "compact")).latest("properties")) == before


def test_redelivery_is_dropped(spark, tmp_path):
    schema = "source string, source_id string, scraped_at timestamp_ntz"
    rows = [("homes", "1", dt.datetime(2026, 1, 1)), ("homes", "1", dt.datetime(2026, 1, 1, 5)), ("homes", "2", dt.datetime(2026, 1, 1))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.drain(jobs.first_deliveries(jobs.feed_stream(spark, str(tmp_path / "in"), schema)), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c"))
    assert sorted(r.source_id for r in seen) == ["1", "2"]


def test_csv_and_geojson_sinks(spark, tmp_path):
    from proplytics.sources.sinks import write_csv, write_geojson

    rows = spark.createDataFrame([(1, "a,b", None)], "id int, address string, note string")
    write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().address == "a,b"
    features = spark.createDataFrame([(1, '{"type":"Feature"}'), (2, '{"type":"Feature"}')], "id int, feature string")
    write_geojson(features, str(tmp_path / "geo"))
    assert spark.read.text(str(tmp_path / "geo")).count() == 2


def test_landed_files_are_read(spark, tmp_path):
    from proplytics.sources import feeds

    tile = tmp_path / "tiles" / "flood" / "15" / "29105"
    tile.mkdir(parents=True)
    (tile / "12903.png").write_bytes(b"x")
    (tile / "12904.png").write_bytes(b"")
    got = {(r.layer, r.z, r.x, r.y): r.present for r in feeds.read_tiles(spark, str(tmp_path / "tiles")).collect()}
    # an empty file is no tile: the scan leaves it out
    assert got == {("flood", 15, 29105, 12903): True}
    bad = tmp_path / "bad" / "lava" / "15" / "1"
    bad.mkdir(parents=True)
    (bad / "1.png").write_bytes(b"x")
    with pytest.raises(Exception, match="unknown layer"):
        feeds.read_tiles(spark, str(tmp_path / "bad")).collect()
    landed = tmp_path / "json" / "year=2023" / "city=13101"
    landed.mkdir(parents=True)
    (landed / "a.json").write_text('{"status":"OK","data":[{"Type":"land","TradePrice":"1000","Area":"10"}]}')
    rows = feeds.read_envelopes(spark, str(tmp_path / "json"), feeds.TRANSACTION_ENVELOPE + ", year int, city string")
    assert rows.select(F.explode("data").alias("d"), "year").select("d.TradePrice", "year").first() == ("1000", 2023)


