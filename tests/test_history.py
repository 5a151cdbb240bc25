"""Price intervals, as-of joins, delisting in batch and as a stream, saved searches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from proplytics.operators import alerts, digests, history
from proplytics.streaming import delist

KEYS = ["source", "listing_id"]
START = dt.datetime(2024, 1, 1)
PRICES = "source string, listing_id string, price long, scraped_at timestamp_ntz"


def sightings(spark, rows):
    return spark.createDataFrame([(s, k, p, None if t is None else START + dt.timedelta(hours=t)) for s, k, p, t in rows], PRICES)


def plain_history(rows):
    """(key, version, price, previous, from, last seen, to) by a loop over sorted sightings."""
    best, out = {}, []
    for s, k, p, t in rows:
        if p is not None and t is not None:
            best[s, k, t] = min(p, best.get((s, k, t), p))
    for key in sorted({x[:2] for x in best}, key=str):
        runs = []
        for t in sorted(t for s, k, t in best if (s, k) == key):
            p = best[(*key, t)]
            if runs and runs[-1][0] == p:
                runs[-1][2] = t
            else:
                runs.append([p, t, t])
        for i, (p, a, b) in enumerate(runs):
            out.append((*key, i + 1, p, runs[i - 1][0] if i else None, a, b, runs[i + 1][1] if i + 1 < len(runs) else None))
    return out


def collected(frame):
    hours = lambda t: None if t is None else (t - START).total_seconds() / 3600
    return sorted(((r.source, r.listing_id, r.version, r.price, r.previous_price, hours(r.valid_from), hours(r.last_seen), hours(r.valid_to)) for r in frame.collect()), key=str)


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), rnd.choice(["x", "y", None]), rnd.choice([None, 1, 1, 2, 3]), float(rnd.randint(0, 3000))) for _ in range(n)]
    # one listing holds a third of all rows; equal rows and two prices at one time
    rows += [("a", "hot", rnd.choice([5, 6]), float(i * 7)) for i in range(n // 2)]
    return rows + rows[:5] + [("a", "x", 9, 12.0), ("a", "x", 1, 12.0), ("a", "x", 4, None)]


@pytest.mark.parametrize("block", ["day", "month", "year"])
def test_history_equals_a_loop(spark, block):
    rows = random_rows(1)
    got = collected(history.price_history(sightings(spark, rows), KEYS, block=block))
    assert got == sorted(plain_history(rows), key=str)
    assert history.price_history(sightings(spark, []), KEYS).collect() == []


def test_intervals_do_not_overlap(spark):
    last = {}
    for r in history.price_history(sightings(spark, random_rows(2)), KEYS).orderBy(*KEYS, "version").collect():
        key = (r.source, r.listing_id)
        assert r.valid_from <= r.last_seen and (r.valid_to is None or r.last_seen < r.valid_to)
        assert last.get(key, r.valid_from) == r.valid_from
        last[key] = r.valid_to


def test_late_sightings_split_an_interval(spark):
    old = history.price_history(sightings(spark, [("a", "x", 100, 0.0), ("a", "x", 100, 50.0), ("a", "x", 120, 90.0), ("a", "y", 7, 1.0)]), KEYS)
    late = sightings(spark, [("a", "x", 110, 20.0), ("a", "x", 100, 30.0), ("a", "z", 1, 5.0), ("a", "x", None, 40.0)])
    assert collected(history.with_late(old, late, KEYS)) == sorted([
        ("a", "x", 1, 100, None, 0.0, 0.0, 20.0), ("a", "x", 2, 110, 100, 20.0, 20.0, 30.0), ("a", "x", 3, 100, 110, 30.0, 50.0, 90.0), ("a", "x", 4, 120, 100, 90.0, 90.0, None),
        ("a", "y", 1, 7, None, 1.0, 1.0, None), ("a", "z", 1, 1, None, 5.0, 5.0, None)], key=str)
    # without late rows nothing changes; all rows late give the history of all rows
    assert collected(history.with_late(old, late.limit(0), KEYS)) == collected(old)
    rows = random_rows(3, 100)
    assert collected(history.with_late(history.price_history(sightings(spark, []), KEYS), sightings(spark, [r for r in rows if r[1]]), KEYS)) == sorted(plain_history([r for r in rows if r[1]]), key=str)


@pytest.mark.parametrize("block", ["day", "month"])
def test_as_of_equals_a_loop(spark, block):
    rows, rnd = [r for r in random_rows(4)], random.Random(5)
    wanted = [(i, *rnd.choice([("a", "x"), ("b", "y"), ("a", "hot"), ("a", None), ("c", "x")]), rnd.choice([None, float(rnd.randint(-50, 3100))])) for i in range(200)]
    asked = spark.createDataFrame([(i, s, k, None if t is None else START + dt.timedelta(hours=t)) for i, s, k, t in wanted], "id int, source string, listing_id string, at timestamp_ntz")
    plain = plain_history(rows)
    found = history.as_of(asked, history.price_history(sightings(spark, rows), KEYS), KEYS, "at", ["price", "version"], block=block).collect()
    assert len(found) == len(wanted)
    for r in found:
        _, s, k, t = wanted[r.id]
        hits = [x for x in plain if x[:2] == (s, k) and t is not None and x[5] <= t]
        want = max(hits, key=lambda x: x[5]) if hits else None
        assert (r.price, r.version) == ((want[3], want[2]) if want else (None, None))


def plain_delistings(seen, runs, missed=3):
    out = []
    for source in {s for s, _ in runs}:
        days = sorted({d for s, d in runs if s == source})
        for listing in {k for s, k, _ in seen if s == source}:
            absent, gone, last = 0, False, None
            mine = {d for s, k, d in seen if (s, k) == (source, listing)}
            for i, d in enumerate(days):
                if d in mine:
                    if gone:
                        out.append((source, listing, "relisted", d, last))
                    absent, gone, last = 0, False, d
                elif last is not None:
                    absent += 1
                    if absent == missed and i + 1 < len(days):
                        out.append((source, listing, "delisted", d, last))
                        gone = True
    return sorted(out)


def crawl(seed, days=25, skip=()):
    rnd = random.Random(seed)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(days)]
    runs = [(s, d) for s in ("a", "b") for d in day if (s, d.day) not in skip]
    seen = [(s, f"L{k}", d) for s, d in runs for k in range(12) if rnd.random() < 0.25 + 0.05 * (k % 5)]
    return seen + [("a", "always", d) for s, d in runs if s == "a"] + [("b", "always", d) for s, d in runs if s == "b"], runs


def test_delistings_equal_a_loop(spark):
    seen, runs = crawl(1, skip={("a", 4), ("a", 5), ("b", 20)})
    frame = spark.createDataFrame([*seen, seen[0], ("a", None, runs[0][1])], "source string, listing_id string, run_day date")
    got = history.delistings(frame, spark.createDataFrame([*runs, runs[0]], "source string, run_day date"))
    assert sorted(tuple(r) for r in got.collect()) == plain_delistings(seen, runs)
    assert history.delistings(frame.limit(0), frame.limit(0).select("source", "run_day")).collect() == []


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    # micro-batches of three days, dealt in any order within
    seen, runs = crawl(2)
    schema = "source string, listing_id string, run_day date"
    for i in range(0, 27, 3):
        part = [r for r in seen if i <= (r[2] - dt.date(2024, 1, 1)).days < i + 3]
        if part:
            random.Random(i).shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "feed" / f"part={i:02d}"))
    stream = spark.readStream.schema(schema + ", part string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "feed"))
    # one source at a time: each is a run a day, and files of both interleave
    got = delist.run_delisting(stream.select("source", "listing_id", "run_day"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == plain_delistings(seen, runs)
    assert len(spark.read.parquet(str(tmp_path / "feed")).inputFiles()) > 5
    assert spark.conf.get(delist.PROVIDER, None) != delist.ROCKSDB


SEARCH = "search_id long, since date, prefecture_code string, municipality_code string, price_min long, price_max long, rebuild_possible boolean, land_min double"
PROPERTY = "id long, status string, created_at timestamp_ntz, prefecture_code string, municipality_code string, price_jpy long, rebuild_possible boolean, land_area_sqm double"


def searches(n, seed, narrow):
    rnd = random.Random(seed)
    for i in range(n):
        low = rnd.choice([None, 0, 1, 9_999, 10_000, rnd.randint(0, 60_000_000)]) if not narrow else rnd.randint(0, 60_000_000)
        high = rnd.choice([None, low, (low or 0) + rnd.randint(0, 10**7), 10**15]) if not narrow else low + 500_000
        pref = f"{rnd.randint(1, 5):02d}"
        place = rnd.choice([(None, None), (pref, None), (None, pref + "101"), (pref, pref + "102")]) if not narrow else (None, pref + "101")
        yield (i, dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 300)), *place, low, high, rnd.choice([None, True, False]), rnd.choice([None, 100.0]))


def offers(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        pref = f"{rnd.randint(1, 5):02d}"
        yield (i, rnd.choice(["active", "sold", "active", None]), dt.datetime(2000, 1, 1) + dt.timedelta(hours=rnd.randint(0, 9000)), rnd.choice([None, pref]), rnd.choice([None, pref + "101", pref + "102"]),
               rnd.choice([None, 0, 1, 9_999, 10_000, rnd.randint(0, 60_000_000), 3 * 10**11]), rnd.choice([None, True, False]), rnd.choice([None, 99.0, 100.0, 200.0]))


def test_digests_equal_those_of_the_matches(spark):
    asked, rows = list(searches(150, 1, False)), list(offers(300, 2))
    at = dt.datetime(2001, 6, 1, 3)
    rows += [rows[0], rows[1], rows[1], (None, "active", at, "01", "01101", 5, True, float("nan")), (901, "active", None, "01", "01101", 5, True, 1.0), (902, "active", at, None, None, None, None, -0.0)]
    rows += [(1000 + i, "active", at, "02", "02101", 7_000_000, False, float(i)) for i in range(60)]  # one price
    asked += [asked[0], (None, *asked[3][1:]), (700, None, *asked[3][2:]), (701, dt.date(2000, 1, 1), None, None, None, None, None, None), (702, dt.date(2000, 1, 1), "02", "02101", 9, 1, None, None),
              (703, dt.date(2000, 1, 1), None, None, None, None, None, 0.0), (704, dt.date(2000, 1, 1), "02", "02101", 7_000_000, 7_000_000, False, float("nan")), (705, dt.date(2000, 1, 1), None, None, 0, None, None, float("-inf"))]
    properties, wanted = spark.createDataFrame(rows, PROPERTY), spark.createDataFrame(asked, SEARCH)
    met = alerts.matches(properties, wanted, ["price_jpy", "created_at"]).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"), F.min("price_jpy").alias("cheapest"), F.max("created_at").alias("newest"))
    want = sorted(map(str, (tuple(r) for r in met.collect())))
    assert len(want) > 80
    for chunk, block in ((9, 7), (digests.CHUNK, digests.BLOCK)):
        found = digests.digest(properties, wanted, chunk, block)
        assert found.dtypes == met.dtypes
        assert sorted(map(str, (tuple(r) for r in found.collect()))) == want


def test_a_digest_does_not_make_the_matches(spark):
    # 3,000 searches find all of 40,000 properties: 120 million matches
    when = F.timestamp_seconds(F.lit(946_684_800) + F.col("id")).cast("timestamp_ntz")
    rows = spark.range(40_000).select("id", F.lit("active").alias("status"), when.alias("created_at"), F.lit("01").alias("prefecture_code"), F.lit("01101").alias("municipality_code"),
                                      (F.col("id") * 500).alias("price_jpy"), F.lit(True).alias("rebuild_possible"), F.lit(80.0).alias("land_area_sqm"))
    none = F.lit(None)
    asked = spark.range(3_000).select(F.col("id").alias("search_id"), F.lit("1999-01-01").cast("date").alias("since"), none.cast("string").alias("prefecture_code"), none.cast("string").alias("municipality_code"),
                                      F.lit(0).cast("long").alias("price_min"), none.cast("long").alias("price_max"), none.cast("boolean").alias("rebuild_possible"), none.cast("double").alias("land_min"))
    found = digests.digest(rows, asked)
    assert found.agg(F.count("*").alias("k"), F.min("n").alias("n"), F.max("cheapest").alias("c")).first() == (3_000, 40_000, 0)


def test_alerts_equal_a_loop(spark):
    asked, rows = list(searches(150, 1, False)), list(offers(200, 2))

    def hit(q, p):
        ok = p[1] == "active" and p[2].date() > q[1]
        for want, have in ((q[2], p[3]), (q[3], p[4]), (q[6], p[6])):
            ok = ok and (want is None or want == have)
        for low, have in ((q[4], p[5]), (q[7], p[7])):
            ok = ok and (low is None or have is not None and have >= low)
        return ok and (q[5] is None or p[5] is not None and p[5] <= q[5])

    got = alerts.matches(spark.createDataFrame(rows, PROPERTY), spark.createDataFrame(asked, SEARCH)).collect()
    want = sorted((q[0], p[0]) for q in asked for p in rows if hit(q, p))
    assert sorted(tuple(r) for r in got) == want and len(want) > 200


def test_blocks_make_up_the_range(spark):
    rnd = random.Random(3)
    ranges = [(0, 0), (0, alerts.TOP), (5, 5), (3, 4), (1, alerts.TOP - 1), (alerts.TOP, alerts.TOP), (7, 6)] + [tuple(sorted((rnd.randint(0, 5000), rnd.randint(0, 5000)))) for _ in range(100)]
    frame = spark.createDataFrame(ranges, "low long, high long")
    for r in frame.withColumn("blocks", alerts._blocks(F.col("low"), F.col("high"))).collect():
        assert len(r.blocks) <= 6 * (alerts.LEVELS + 1)
        spans = sorted((b.block * 4**b.level, (b.block + 1) * 4**b.level - 1) for b in r.blocks)
        if r.low > r.high:
            assert spans == []
            continue
        assert spans[0][0] == r.low and spans[-1][1] == r.high and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


def test_few_candidates_among_many_searches(spark):
    asked = spark.createDataFrame(list(searches(10_000, 4, True)), SEARCH)
    rows = spark.createDataFrame(list(offers(500, 5)), PROPERTY)
    met = alerts.candidates(rows, asked).agg(F.count("*").alias("n"), F.max("q.price_min").alias("m")).first()
    # a search asks for one of five places and 1/120 of the prices: about 17 of 10,000 searches fit the place and price of a property
    assert 0 < met.n / 500 < 30
    assert alerts.candidates(rows, asked).groupBy("p.id", "q.search_id").count().where("count > 1").isEmpty()
