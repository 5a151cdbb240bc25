"""Digests of saved searches: how many new matches, the cheapest, the newest, without the matches themselves.

Matches grow with properties times searches, so they are not made. Properties of a place are cut into chunks of neighbouring prices, a search
meets the chunks that its price range touches, and a chunk answers all its searches at once from sorted arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from proplytics.operators.alerts import TOP, _step

#: properties of a chunk and searches of a block, about; what has one price beyond that is cut by hash
CHUNK, BLOCK = 1 << 18, 1 << 20
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def range_digest(day: np.ndarray, land: np.ndarray, price: np.ndarray, unpriced: int, created: np.ndarray,
                 since: np.ndarray, least: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, place of the cheapest or ``len(price)``, latest ``created``) of the rows with day > since, land >= least and low <= place < high, for each question.

    Rows come in order of price; a row's place is its number, and the first ``unpriced`` are never the cheapest. Rows in order of day are cut into
    blocks of powers of two, so the days of a question are one block for each bit of their number; a block is cut the same way by land, and what is
    left is a stretch of places.
    """
    rows, n = len(day), np.zeros(len(since), np.int64)
    cheapest, newest = np.full(len(since), rows, np.int64), np.full(len(since), LOWEST, np.int64)
    by_day = np.argsort(-day, kind="stable")
    days = np.searchsorted(-day[by_day], -since, "left")
    # lands as numbers from 0, so that block and land fit into one key
    lands = np.unique(land)
    land_no, least_no, span = np.searchsorted(lands, land), np.searchsorted(lands, least, "left"), len(lands) + 1
    for j in range(rows.bit_length()):
        some = np.flatnonzero((days >> j & 1).astype(bool) & (low < high))
        if not len(some):
            continue
        # largest land first within a block of 2 ** j days
        key = (np.arange(rows) >> j) * span + (span - 1 - land_no[by_day])
        order = np.argsort(key, kind="stable")
        key, by_land = key[order], by_day[order]
        block = (days[some] >> (j + 1)) << 1
        begin = block << j
        taken = np.searchsorted(key, block * span + (span - 1 - least_no[some]), "right") - begin
        for i in range(j + 1):
            at = np.flatnonzero(taken >> i & 1)
            if not len(at):
                continue
            asked, part = some[at], (begin[at] + ((taken[at] >> (i + 1)) << (i + 1))) >> i
            places = np.sort((np.arange(rows) >> i) * rows + by_land)
            first = np.searchsorted(places, part * rows + low[asked], "left")
            last = np.searchsorted(places, part * rows + high[asked], "left")
            hit = first < last
            asked, part, first, last = asked[hit], part[hit], first[hit], last[hit]
            if not len(asked):
                continue
            n[asked] += last - first
            lead = np.searchsorted(places, part * rows + np.maximum(low[asked], unpriced), "left") if unpriced else first
            priced = lead < last
            cheapest[asked[priced]] = np.minimum(cheapest[asked[priced]], places[lead[priced]] % rows)
            # latest of every stretch of 2 ** k places
            latest = np.empty((i + 1, rows), np.int64)
            latest[0] = created[places % rows]
            for k in range(i):
                latest[k + 1] = latest[k]
                np.maximum(latest[k, : -(1 << k)], latest[k, 1 << k :], out=latest[k + 1, : -(1 << k)])
            length = np.frexp((last - first).astype(np.float64))[1] - 1
            newest[asked] = np.maximum(newest[asked], np.maximum(latest[length, first], latest[length, last - (1 << length)]))
    return n, cheapest, newest


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit numbers, which are null) of a column of whole numbers or times."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _ordered(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles as whole numbers in their order: null below all, NaN above all."""
    null, value = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    bits = value.view(np.int64)
    key = np.where(bits < 0, bits ^ HIGHEST, bits)
    key[np.isnan(value)] = HIGHEST
    key[null] = LOWEST
    return key


def _answer(price_type: pa.DataType, time_type: pa.DataType):
    """Digests of the searches of a block over the properties of a chunk."""

    def run(rows: pa.Table, searches: pa.Table) -> pa.Table:
        asked = searches.num_rows if rows.num_rows else 0
        n, cheapest, newest, free = np.zeros(asked, np.int64), np.zeros(asked, np.int64), np.zeros(asked, np.int64), np.ones(asked, bool)
        if asked:
            price, unpriced = _numbers(rows["price"])
            order = np.lexsort((price, ~unpriced))
            price, unpriced = price[order], unpriced[order]
            land, (day, _), (created, _) = _ordered(rows["land"])[order], _numbers(rows["day"]), _numbers(rows["created"])
            day, created = day[order], created[order]
            rebuild, flag = (t["rebuild"].cast(pa.int8()).fill_null(2).to_numpy() for t in (rows, searches))
            rebuild = rebuild[order]
            (low, no_low), (high, no_high), (since, _) = _numbers(searches["price_min"]), _numbers(searches["price_max"]), _numbers(searches["since"])
            least = _ordered(searches["land_min"])
            for wanted in (0, 1, 2):
                own, mine = np.flatnonzero((rebuild == wanted) | (wanted == 2)), np.flatnonzero(flag == wanted)
                if not len(own) or not len(mine):
                    continue
                # a search without bounds also finds what has no price
                none = int(unpriced[own].sum())
                some = price[own][none:]
                begin = np.where(no_low[mine], np.where(no_high[mine], 0, none), none + np.searchsorted(some, low[mine], "left"))
                end = np.where(no_high[mine], len(own), none + np.searchsorted(some, high[mine], "right"))
                n[mine], place, newest[mine] = range_digest(day[own], land[own], price[own], none, created[own], since[mine], least[mine], begin, end)
                free[mine] = place == len(own)
                cheapest[mine] = price[own][np.minimum(place, len(own) - 1)]
        found = np.flatnonzero(n)
        return pa.table({"search_id": searches["search_id"].take(pa.array(found)), "n": pa.array(n[found]),
                         "cheapest": pa.array(cheapest[found], mask=free[found]).cast(price_type), "newest": pa.array(newest[found]).cast(time_type)})

    return run


def _place(municipality: Column, prefecture: Column) -> Column:
    return F.to_json(F.struct(municipality.alias("m"), prefecture.alias("p")))


def digest(properties: DataFrame, searches: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(search_id, n, cheapest, newest) of every search with a match: what ``alerts.matches`` finds, counted, with the lowest price and the latest created_at.

    A property stands under its municipality, its prefecture, both, and everywhere; a search asks one of these. The properties of a place are cut at prices
    into chunks of about ``chunk`` and its searches by hash into blocks of about ``block``, so a group holds neither more. A search costs one question for each
    chunk that its price range touches, each of which takes the square of the logarithm of ``chunk``.
    """
    from proplytics.session import materialise

    price_type, time_type = properties.schema["price_jpy"], properties.schema["created_at"]
    nothing = F.lit(None).cast("string")
    kinds = [_place(m, p) for m in (F.col("municipality_code"), nothing) for p in (F.col("prefecture_code"), nothing)]
    step = F.coalesce(_step(F.col("price_jpy")), F.lit(-1).cast("bigint"))
    wanted = properties.where("status = 'active' and created_at is not null").select(
        "*", F.explode(F.array_distinct(F.array(*kinds))).alias("place"), step.alias("step"))
    asked = searches.where("since is not null").select(
        "search_id", F.unix_date(F.col("since").cast("date")).alias("since"), F.col("price_min").cast("bigint").alias("price_min"), F.col("price_max").cast("bigint").alias("price_max"),
        F.col("rebuild_possible").alias("rebuild"), F.col("land_min").cast("double").alias("land_min"), _place(F.col("municipality_code"), F.col("prefecture_code")).alias("place"))

    # chunks of each place that is asked: a row a place, with the first step and the parts of each chunk
    blocks = asked.groupBy("place").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    counts = wanted.groupBy("place", "step").agg(F.count("*").alias("k")).join(blocks, "place")
    before = F.coalesce(F.sum("k").over(Window.partitionBy("place").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = counts.withColumn("chunk", F.floor(before / F.lit(chunk))).groupBy("place", "blocks", "chunk").agg(
        F.min("step").alias("start"), F.ceil(F.sum("k") / F.lit(2 * chunk)).cast("int").alias("parts"))
    cuts = chunks.groupBy("place", "blocks").agg(F.array_sort(F.collect_list(F.struct("start", "parts"))).alias("cuts"))
    cuts = materialise(cuts)

    def last_from(value: Column) -> Column:
        return F.size(F.filter("cuts", lambda c: c["start"] <= value))

    rows = wanted.join(cuts, "place").withColumn("chunk", last_from(F.col("step")))
    parts = F.element_at("cuts", F.col("chunk"))["parts"]
    keys = ["place", "chunk", "part", "block"]
    rows = rows.select(
        "place", "chunk", F.pmod(F.xxhash64("id", "price_jpy", "land_area_sqm", "created_at"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.col("price_jpy").cast("bigint").alias("price"), F.col("land_area_sqm").cast("double").alias("land"), F.col("rebuild_possible").alias("rebuild"),
        F.unix_date(F.col("created_at").cast("date")).alias("day"), F.col("created_at").alias("created"))
    # without bounds from what has no price, with an upper bound alone from the first price
    low = F.coalesce(_step(F.col("price_min")), F.when(F.col("price_max").isNotNull(), F.lit(0)).otherwise(-1).cast("bigint"))
    met = asked.join(cuts, "place").select("*", F.greatest(last_from(low), F.lit(1)).alias("first"), last_from(F.coalesce(_step(F.col("price_max")), F.lit(TOP).cast("bigint"))).alias("last"))
    met = met.where(F.col("first") <= F.col("last")).select("*", F.explode(F.sequence("first", "last")).alias("chunk"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.element_at("cuts", F.col("chunk"))["parts"] - 1)).alias("part"))
    met = met.select(*keys[:3], F.pmod(F.xxhash64("search_id"), F.col("blocks")).cast("int").alias("block"), "search_id", "since", "price_min", "price_max", "rebuild", "land_min")

    out = StructType([searches.schema["search_id"], StructField("n", LongType()), StructField("cheapest", price_type.dataType), StructField("newest", time_type.dataType)])
    arrow = to_arrow_schema(out)
    answers = rows.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(_answer(arrow.field("cheapest").type, arrow.field("newest").type), out)
    return answers.groupBy("search_id").agg(F.sum("n").alias("n"), F.min("cheapest").alias("cheapest"), F.max("newest").alias("newest"))
