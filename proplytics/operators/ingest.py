"""Load a batch of listings into the property, listing and image snapshots.

Every step is a function of DataFrames: the batch is folded to one row per listing, resolved to
properties (stored or founded in this batch), folded to one update per property, and merged. Stored
tables take part as the left side of left joins only, so a small batch is broadcast and the
big table is not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.functions.numbers import price_per_sqm
from proplytics.functions.text import normalize_address, storage_path
from proplytics.operators.match import first_within, match_cascade, one_per_address, similar_texts
from proplytics.operators.score import stub_scores

# a later value replaces an earlier one when it is not null / not empty
NUMBERS = ["price", "land_area_sqm", "building_area_sqm", "year_built", "floors", "road_width_m", "road_frontage_m",
           "rebuild_possible", "coverage_ratio", "floor_area_ratio"]
TEXTS = ["floor_plan", "structure", "use_zone", "city_planning_zone", "address", "prefecture"]
LISTING_KEY = ["source", "source_id"]
PORTALS = ["suumo", "homes", "athome", "akiya", "bit"]


# --- gates ---------------------------------------------------------------------


def digit_code(c: Column) -> Column:
    """Municipality only where it is a code, not a name."""
    return F.when(c.rlike("^[0-9]+$"), c)


def price_gate(price: Column, low: int | None = None, high: int | None = None) -> Column:
    """Unknown and free prices pass; others must lie inside the range asked for."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (price >= low)
    if high is not None:
        inside = inside & (price <= high)
    return price.isNull() | (price == 0) | inside


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def valid_listing(source: Column, address: Column, price: Column, title: Column, url: Column) -> Column:
    """Per portal: enough content to keep? A price of 0 counts for vacant houses only."""
    akiya = _filled(address) | price.isNotNull() | _filled(title)
    auction = _filled(url) | _filled(address)
    portal = _filled(address) | F.coalesce(price != 0, F.lit(False))
    return F.when(source == "akiya", akiya).when(source == "bit", auction).otherwise(portal)


def faults(rows: DataFrame) -> DataFrame:
    """Rows with ``fault``: what keeps the row from loading, null when nothing does."""
    c = F.col
    checks = [
        (~_filled(c("source")) | ~c("source").isin(PORTALS), "unknown source"),
        (~_filled(c("source_id")), "no source id"),
        (c("price") < 0, "negative price"),
        (F.length("prefecture") > 2, "prefecture is not a code"),
    ]
    fault = F.lit(None).cast("string")
    for wrong, message in reversed(checks):
        fault = F.when(wrong, message).otherwise(fault)
    return rows.withColumn("fault", fault)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to load, quarantine with the fault): one bad row does not stop the rest."""
    checked = faults(rows)
    return checked.where(F.col("fault").isNull()).drop("fault"), checked.where(F.col("fault").isNotNull())


def error_message(quarantine: DataFrame, first: int = 5) -> DataFrame:
    """The first errors in key order as one text; a top-k, so the rest is never collected."""
    line = F.concat_ws(": ", F.lit("Upsert failed"), F.coalesce("source_id", F.lit("")), "fault")
    top = quarantine.select(line.alias("line"), *LISTING_KEY).orderBy(*LISTING_KEY, "line").limit(first)
    ordered = F.array_sort(F.collect_list(F.struct(*LISTING_KEY, "line")))
    return top.agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "; ").alias("error_message"))


# --- one row per listing ----------------------------------------------------------


def last_write(feed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in the order of ``order``; combines map-side, no window."""
    rest = [c for c in feed.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return feed.groupBy(*keys).agg(pick).select(*keys, "_r.*")


def _later(name: str, filled: Column, order: Column) -> Column:
    return F.max_by(F.col(name), F.when(filled, order)).alias(name)


def _sequence(columns: list[str]) -> Column:
    """One sortable text from a timestamp and what breaks its ties.

    A single key keeps the twenty aggregates below within one compiled method.
    """
    first, *rest = columns
    micros = F.lpad(F.unix_micros(F.col(first).cast("timestamp")).cast("string"), 20, "0")
    return F.concat_ws("|", micros, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest])


def _merge_aggregates(order: Column) -> list[Column]:
    """For each column the last value worth keeping, in the order given."""
    aggs = [_later(n, F.col(n).isNotNull(), order) for n in NUMBERS]
    aggs += [_later(n, _filled(F.col(n)), order) for n in TEXTS]
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    aggs += [_later("latitude", both, order), _later("longitude", both, order)]
    code = digit_code(F.col("municipality"))
    return aggs + [F.max_by(code, F.when(code.isNotNull(), order)).alias("municipality_code")]


def fold_listings(feed: DataFrame, order: list[str] = ("scraped_at",)) -> DataFrame:
    """One row per (source, source_id): later values win, gaps keep the earlier value."""
    sequence = F.col("_seq")
    whole = F.max_by(F.struct("source_url", "title", "image_urls", "raw_data", "municipality"), sequence).alias("_last")
    return (
        feed.withColumn("_seq", _sequence(order))
        .groupBy(*LISTING_KEY)
        .agg(*_merge_aggregates(sequence), whole, F.min("scraped_at").alias("first_seen"), F.max("scraped_at").alias("scraped_at"))
        .select("*", "_last.*")
        .drop("_last")
    )


# --- which property ------------------------------------------------------------


def _anchor() -> Column:
    """The address a listing stands for, or a value of its own when it has none.

    Its own value also keeps unknown addresses apart in the joins: no partition of nulls.
    """
    usable = _filled(F.col("address")) & (F.col("address") != "Unknown")
    return F.when(usable, F.col("address")).otherwise(F.concat(F.lit("\u0000"), F.col("source"), F.lit(":"), F.col("source_id")))


def listing_key() -> Column:
    return F.concat(F.col("source"), F.lit(":"), F.col("source_id"))


def with_known(batch: DataFrame, listings: DataFrame) -> DataFrame:
    """Batch rows with known_id, the property of a listing stored before."""
    known = listings.select(
        F.col("source_id").alias("source"), F.col("source_listing_id").alias("source_id"), F.col("property_id").alias("known_id")
    )
    return batch.join(known, LISTING_KEY, "left")


def resolve_by_address(batch: DataFrame, listings: DataFrame, properties: DataFrame) -> DataFrame:
    """Batch rows with property_id and is_new.

    A listing stored before keeps its property; else the property of exactly its address; else a
    property founded by the first listing of that address in the batch.
    """
    stored = one_per_address(properties).withColumnsRenamed({"_address": "anchor"})
    rows = with_known(batch, listings).withColumn("anchor", _anchor()).join(stored, "anchor", "left")
    return _found(rows, F.col("anchor"))


def _found(rows: DataFrame, group: Column) -> DataFrame:
    rows = rows.withColumns({"_fresh": F.col("known_id").isNull() & F.col("match_id").isNull(), "_group": group})
    founders = (
        rows.where("_fresh")
        .groupBy("_group")
        .agg(F.min(F.struct("first_seen", "source", "source_id")).alias("_f"))
        .select("_group", F.concat("_f.source", F.lit(":"), "_f.source_id").alias("founder_id"))
    )
    joined = rows.join(founders, "_group", "left")
    return joined.withColumns(
        {
            "property_id": F.coalesce("known_id", "match_id", "founder_id"),
            "is_new": F.col("_fresh") & (F.col("founder_id") == listing_key()),
            "is_listed": F.col("known_id").isNotNull(),
        }
    ).drop("_group", "_fresh", "founder_id", "known_id", "match_id")


def resolve_by_tiers(batch: DataFrame, listings: DataFrame, properties: DataFrame) -> DataFrame:
    """Like resolve_by_address, with the three matching tiers in place of the exact address.

    Rows no stored property matches are matched among themselves the same way: each points at its
    first match earlier in the batch, and the pointers are followed to the listing that founds.
    """
    from proplytics.session import materialise

    rows = materialise(
        with_known(batch, listings).withColumns(
            {"address_normalized": normalize_address(F.col("address")), "lat": F.col("latitude"), "lng": F.col("longitude"), "key": listing_key()}
        )
    )
    asked = rows.where(F.col("known_id").isNull()).select("key", "address_normalized", "municipality", "lat", "lng")
    matched = materialise(match_cascade(asked, properties).select("key", "match_id"))
    rest = asked.join(matched.select("key"), "key", "left_anti")
    loose = materialise(
        rest.join(rows.select("key", F.col("address").alias("address_ja"), "first_seen"), "key").withColumn(
            "id", F.concat(F.date_format("first_seen", "yyyyMMddHHmmss"), F.lit("|"), F.col("key"))
        )
    )
    roots = follow(parents_within(loose))
    rows = rows.join(matched, "key", "left").join(roots, "key", "left")
    return _found(rows.drop("lat", "lng"), F.coalesce("root", "key")).drop("key", "root")


def parents_within(rows: DataFrame) -> DataFrame:
    """(key, parent): for each row the first earlier row of the batch it matches, else itself.

    ``id`` is the order of arrival. A row that is not the first of its normalised address points
    at that first row; only firsts look further, by similar address, then by distance. Every row
    emits one edge, so no group is ever spelled out in pairs.
    """
    named = F.col("address_normalized") != ""
    firsts = rows.where(named).groupBy("address_normalized").agg(F.min("id").alias("_first"))
    rows = rows.join(firsts, "address_normalized", "left")
    edges = rows.where(F.col("_first") < F.col("id")).select("key", F.col("_first").alias("_to"))
    heads = rows.where(F.col("_first").isNull() | (F.col("_first") == F.col("id"))).drop("_first")
    texts = heads.where(named)
    asked = texts.select(F.col("address_normalized").alias("l"), "key", "municipality", F.col("id").alias("_own"))
    others = texts.select(F.col("address_normalized").alias("r"), "address_ja", "id")
    near = similar_texts(texts, texts).where("l != r").join(asked, "l").join(others, "r")
    near = near.where((F.col("id") < F.col("_own")) & F.contains("address_ja", "municipality"))
    similar = near.groupBy("key").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("_to"))
    rest = heads.join(similar.select("key"), "key", "left_anti")
    close = first_within(rest.select("key", "lat", "lng"), rows.select("id", "lat", "lng")).join(
        rest.select("key", F.col("id").alias("_own")), "key"
    )
    edges = edges.unionByName(similar).unionByName(
        close.where(F.col("match_id") < F.col("_own")).select("key", F.col("match_id").alias("_to"))
    )
    parent = F.coalesce(F.substring_index("_to", "|", -1), F.col("key"))
    return rows.select("key").join(edges, "key", "left").select("key", parent.alias("parent"))


def follow(parents: DataFrame) -> DataFrame:
    """(key, root) by pointer doubling: log2 of the longest chain rounds, each written out."""
    from proplytics.session import materialise

    current = materialise(parents.withColumnRenamed("parent", "root"))
    while True:
        up = current.select(F.col("key").alias("root"), F.col("root").alias("_next"))
        step = materialise(current.join(up, "root").select("key", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved")))
        if step.where("moved").limit(1).count() == 0:
            return step.select("key", "root")
        current = step.select("key", "root")


# --- merge ----------------------------------------------------------------------


@dataclass
class Snapshots:
    properties: DataFrame
    listings: DataFrame
    images: DataFrame
    scores: DataFrame
    hazards: DataFrame
    outcomes: DataFrame


def fold_updates(resolved: DataFrame) -> DataFrame:
    """One update per property from all its listings in the batch, in order of sighting."""
    order = F.col("_seq")
    rows = resolved.withColumns(
        {"municipality": F.coalesce("municipality_code", "municipality"), "_seq": _sequence(["scraped_at", *LISTING_KEY])}
    )
    return rows.groupBy(F.col("property_id").alias("id")).agg(
        *_merge_aggregates(order),
        F.min("first_seen").alias("first_seen"),
        F.max("scraped_at").alias("last_seen"),
        F.bool_or("is_new").alias("_founded"),
        F.bool_or(~F.col("is_listed")).alias("_attached"),
    )


# batch column → property column
RENAMED = {"price": "price_jpy", "address": "address_ja", "prefecture": "prefecture_code", "latitude": "lat", "longitude": "lng"}


def merge_properties(properties: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """Next property snapshot: stored rows with their update, then founded rows with defaults."""
    merged = [*NUMBERS, *TEXTS, "latitude", "longitude", "municipality_code"]
    delta = updates.select("id", *[F.col(n).alias(f"_{RENAMED.get(n, n)}") for n in merged], "first_seen", "last_seen", "_founded", "_attached")
    stored = properties.join(delta.drop("first_seen", "_founded"), "id", "left")
    defaults = {"status": F.lit("active"), "created_at": F.col("first_seen")}
    blank = [
        defaults.get(n, F.lit(None)).cast(t).alias(n) for n, t in properties.dtypes if n != "id"
    ]
    carried = [c for c in delta.columns if c not in ("id", "first_seen", "_founded")]
    founded = delta.where("_founded").select("id", *blank, *carried)
    rows = stored.unionByName(founded)
    new = {n: F.coalesce(F.col(f"_{n}"), F.col(n)) for n in (RENAMED.get(m, m) for m in merged) if n in properties.columns}
    new["address_ja"] = F.coalesce(new["address_ja"], F.lit("Unknown"))
    new["price_jpy"] = F.coalesce(new["price_jpy"], F.lit(0).cast("bigint"))
    touched = F.col("last_seen").isNotNull()
    if "address_normalized" in properties.columns:
        new["address_normalized"] = F.when(F.col("_address_ja").isNotNull(), normalize_address(F.col("_address_ja"))).otherwise(F.col("address_normalized"))
    if "last_seen_at" in properties.columns:
        new["last_seen_at"] = F.coalesce("last_seen", "last_seen_at")
    if "updated_at" in properties.columns:
        new["updated_at"] = F.when(touched, as_of).otherwise(F.col("updated_at"))
    rows = rows.withColumns(new)
    if "price_per_sqm" in properties.columns:
        per = price_per_sqm(F.col("price_jpy"), F.col("land_area_sqm"))
        rows = rows.withColumn("price_per_sqm", F.coalesce(F.when(F.col("_attached"), per), F.col("price_per_sqm")))
    return rows.select(*properties.columns)


def merge_listings(listings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Next listing snapshot: known listings refreshed and active again, new ones appended."""
    side = resolved.where("is_listed").select(
        F.col("source").alias("source_id"), F.col("source_id").alias("source_listing_id"), F.col("scraped_at").alias("_at"), F.col("raw_data").alias("_raw")
    )
    hit = F.col("_at").isNotNull()
    refreshed = listings.join(side, ["source_id", "source_listing_id"], "left").withColumns(
        {
            "raw_data_json": F.when(hit, F.col("_raw")).otherwise(F.col("raw_data_json")),
            "last_scraped_at": F.coalesce("_at", "last_scraped_at"),
            "listing_status": F.when(hit, "active").otherwise(F.col("listing_status")),
        }
    ).select(*listings.columns)
    added = resolved.where(~F.col("is_listed")).select(
        "property_id", F.col("source").alias("source_id"), F.col("source_id").alias("source_listing_id"), "source_url",
        F.col("raw_data").alias("raw_data_json"), F.lit("active").alias("listing_status"),
        F.col("first_seen").alias("first_scraped_at"), F.col("scraped_at").alias("last_scraped_at"),
        F.lit(None).cast("timestamp_ntz").alias("delisted_at"),
    )
    return refreshed.unionByName(added.select(*listings.columns))


def image_rows(resolved: DataFrame) -> DataFrame:
    """Images of newly added listings with their ordinal, in page order."""
    rows = resolved.where(~F.col("is_listed")).select("property_id", F.posexplode("image_urls").alias("sort_order", "url"))
    return rows.select(
        "property_id", F.col("url").alias("storage_path"), "sort_order",
        F.concat(F.lit("Property image "), (F.col("sort_order") + 1).cast("string")).alias("alt_text"),
        F.when(F.col("sort_order") == 0, "exterior").otherwise("interior").alias("image_type"),
    )


def upsert(
    feed: DataFrame, listings: DataFrame, properties: DataFrame, as_of: Column, tiers: bool = False, order: list[str] = ("scraped_at",)
) -> Snapshots:
    """Next snapshots after loading ``feed``."""
    return apply_batch(fold_listings(feed, order), listings, properties, as_of, tiers)


def apply_batch(batch: DataFrame, listings: DataFrame, properties: DataFrame, as_of: Column, tiers: bool = False) -> Snapshots:
    """Snapshots from a folded batch. The resolved batch feeds six outputs, so it is written once."""
    from proplytics.session import materialise

    resolved = materialise((resolve_by_tiers if tiers else resolve_by_address)(batch, listings, properties))
    fresh = resolved.where("is_new")
    scores = stub_scores(fresh).select(
        "property_id", "rebuild_score", "hazard_score", "infrastructure_score", "demographic_score", "value_score",
        "condition_score", "composite_score", "scoring_version",
    )
    return Snapshots(
        properties=merge_properties(properties, fold_updates(resolved), as_of),
        listings=merge_listings(listings, resolved),
        images=image_rows(resolved),
        scores=scores,
        hazards=fresh.select("property_id", as_of.alias("assessed_at")),
        outcomes=resolved.select(*LISTING_KEY, "property_id", "is_new"),
    )


def run_summary(outcomes: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """found / new / updated / errors of one run."""
    n = F.count(F.lit(1))
    done = outcomes.agg(n.alias("loaded"), F.count_if("is_new").alias("listings_new")).withColumn("_k", F.lit(1))
    if quarantine is None:
        errors = outcomes.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("errors"), F.lit(1).alias("_k"))
    else:
        errors = quarantine.agg(n.alias("errors")).withColumn("_k", F.lit(1))
    return done.join(errors, "_k").select(
        (F.col("loaded") + F.col("errors")).alias("listings_found"), "listings_new",
        (F.col("loaded") - F.col("listings_new")).alias("listings_updated"), "errors",
    )


def upsert_scores(current: DataFrame, delta: DataFrame) -> DataFrame:
    """One score per (property, version); a new one replaces the old."""
    # each key once: what only adds columns to the delta need not be joined again for them
    keys = delta.select("property_id", "scoring_version").distinct()
    kept = current.join(keys, ["property_id", "scoring_version"], "left_anti")
    return kept.unionByName(delta.select(*current.columns))


def denormalise_scores(properties: DataFrame, scores: DataFrame) -> DataFrame:
    """Copy fresh composite scores onto the properties."""
    side = scores.select(F.col("property_id").alias("id"), F.col("composite_score").alias("_score"))
    joined = properties.join(side, "id", "left")
    return joined.withColumn("composite_score", F.coalesce("_score", "composite_score")).drop("_score")


# --- constraints -----------------------------------------------------------------


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def dangling(table: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names nothing in the dimension; unset references pass."""
    return table.where(F.col(column).isNotNull()).join(
        dimension.select(F.col(key).alias(column)).distinct(), column, "left_anti"
    )


def union_portals(frames: list[DataFrame]) -> DataFrame:
    """Listings of several portals in one schema, matched by column name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def image_paths(images: DataFrame) -> DataFrame:
    """Stored path of each image(property_id, sort_order, content_type)."""
    return images.withColumn("storage_path", storage_path(F.col("property_id"), F.col("sort_order"), F.col("content_type")))
