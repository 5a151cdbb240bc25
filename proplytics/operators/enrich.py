"""Lookups against landed memories: gazetteer (geocoding) and translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proplytics.functions.text import simplify_address

API_BATCH = 128
#: characters that one call takes
CALL_CHARACTERS = 5000


def needs_geocoding(properties: DataFrame) -> DataFrame:
    return properties.where(F.col("lat").isNull() & F.col("address_ja").isNotNull())


def pending_geocoding(properties: DataFrame, limit: int) -> DataFrame:
    n = F.count(F.lit(1))
    return needs_geocoding(properties).agg(n.alias("pending"), F.least(F.lit(limit), n).alias("batch_size"))


def geocoding_batch(properties: DataFrame, limit: int) -> DataFrame:
    """The next rows to geocode in id order (top-k)."""
    return needs_geocoding(properties).orderBy("id").limit(limit)


def address_quality(properties: DataFrame) -> DataFrame:
    unknown = F.col("address_ja").isNull() | (F.col("address_ja") == "Unknown")
    return properties.agg(
        F.count_if(unknown).alias("unknown"), F.count_if(~unknown & F.col("lat").isNull()).alias("known_ungeocoded")
    )


def ungeocoded_sample(properties: DataFrame, n: int) -> DataFrame:
    return needs_geocoding(properties).where(F.col("address_ja") != "Unknown").orderBy("id").limit(n)


def gazetteer_lookup(addresses: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of distinct addresses: exact entry first, else the simplified address.

    gazetteer(address, lat, lng) has one row per address. Hot addresses meet it once.
    """
    wanted = addresses.select("address_ja").distinct().withColumn("simple", simplify_address(F.col("address_ja")))
    exact = gazetteer.select(F.col("address").alias("address_ja"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    loose = gazetteer.select(F.col("address").alias("simple"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    hit = wanted.join(exact, "address_ja", "left").join(loose, "simple", "left")
    return hit.select(
        "address_ja",
        F.coalesce("lat1", "lat2").alias("found_lat"),
        F.when(F.col("lat1").isNotNull(), F.col("lng1")).otherwise(F.col("lng2")).alias("found_lng"),
    )


def geocode(properties: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Fill missing coordinates in one pass and name each row's outcome."""
    pending = F.col("lat").isNull() & F.col("address_ja").isNotNull() & (F.col("address_ja") != "")
    found = gazetteer_lookup(needs_geocoding(properties).where(F.col("address_ja") != ""), gazetteer)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("found_lat", "double"), ("found_lng", "double"))]
    # only rows that need a lookup meet the gazetteer
    open_rows = F.col("lat").isNull() & F.col("address_ja").isNotNull()
    asked = properties.where(open_rows).join(found, "address_ja", "left").select(*properties.columns, "found_lat", "found_lng")
    joined = asked.unionByName(properties.where(~open_rows).select("*", *nothing))
    outcome = (
        F.when(F.col("lat").isNotNull() | F.col("address_ja").isNull(), "none")
        .when(F.col("address_ja") == "", "skipped")
        .when(F.col("found_lat").isNotNull(), "success")
        .otherwise("failed")
    )
    return joined.withColumns(
        {
            "outcome": outcome,
            "lng": F.when(pending & F.col("found_lat").isNotNull(), F.col("found_lng")).otherwise(F.col("lng")),
            "lat": F.when(pending, F.col("found_lat")).otherwise(F.col("lat")),
        }
    ).drop("found_lat", "found_lng")


def outcome_stats(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    o = F.col(outcome)
    return rows.agg(
        F.count_if(o != "none").alias("total"),
        F.count_if(o == "success").alias("success"),
        F.count_if(o == "failed").alias("failed"),
        F.count_if(o == "skipped").alias("skipped"),
    )


def translate(rows: DataFrame, memory: DataFrame, text: str = "text") -> DataFrame:
    """Translation of each text from memory(text, translated); blanks and misses keep the text.

    Only distinct non-blank texts are looked up. A text longer than a call takes is sent in pieces, and its translation is that
    of its pieces in order; a piece that the memory does not know stays as it is.
    """
    blank = F.col(text).isNull() | (F.trim(text) == "")
    key = F.sha2(F.col(text), 256)
    wanted = rows.where(~blank).select(key.alias("_k"), F.col(text).alias("_t")).dropDuplicates(["_k"])
    sent = wanted.select("_k", F.posexplode(pieces(F.col("_t"))).alias("_no", "sent"))
    known = memory.select(F.col("text").alias("sent"), "translated")
    hits = sent.join(known, "sent", "left").select("_k", F.struct("_no", F.coalesce("translated", "sent").alias("t")).alias("_p"))
    whole = hits.groupBy("_k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["t"]), "").alias("translated"))
    joined = rows.withColumn("_k", F.when(~blank, key)).join(whole, "_k", "left").drop("_k")
    return joined.withColumn("translated", F.coalesce("translated", F.col(text)))


def pieces(text: Column, size: int = CALL_CHARACTERS) -> Column:
    """The text in pieces of ``size`` characters; none of it is lost."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


BLOCK_BITS = (16, 32, 48)


def dense_ordinals(rows: DataFrame, key: str, name: str = "ordinal", weight: str | None = None) -> DataFrame:
    """Exact 0-based position of each row in the order of a unique 64-bit key, without a global sort.

    With ``weight``, a row takes so many positions and gets the first of them.

    Keys fall into blocks of 2^16; a block holds at most 65536 rows, so it is ranked in one
    window, and its offset is the sum of the blocks before it. Offsets are summed the same way
    over blocks of blocks, so no window anywhere sees more than 65536 rows.
    """
    k = F.col(key)
    first = F.shiftright(k, BLOCK_BITS[0])
    own = F.col(weight) if weight else F.lit(1)
    local = Window.partitionBy(first).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumns({"_b": first, "_pos": F.coalesce(F.sum(own).over(local), F.lit(0)).cast("bigint")})
    counts = rows.groupBy(first.alias("_b")).agg(F.sum(own).cast("bigint").alias("_n"))
    return (
        ranked.join(_offsets(counts, len(BLOCK_BITS) - 1), "_b")
        .withColumn(name, F.col("_off") + F.col("_pos"))
        .drop("_b", "_off", "_pos")
    )


def _offsets(counts: DataFrame, levels: int) -> DataFrame:
    """(_b, _off): rows before each block, from (_b, _n)."""
    if levels == 0:  # at most 65536 rows by now: the top 16 bits of the key
        order = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("_b", F.coalesce(F.sum("_n").over(order), F.lit(0).cast("bigint")).alias("_off"))
    upper = F.shiftright(F.col("_b"), 16)
    inner = Window.partitionBy(upper).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select(
        "_b", upper.alias("_u"), F.coalesce(F.sum("_n").over(inner), F.lit(0).cast("bigint")).alias("_in")
    )
    above = counts.groupBy(upper.alias("_b")).agg(F.sum("_n").alias("_n"))
    tops = _offsets(above, levels - 1).select(F.col("_b").alias("_u"), F.col("_off").alias("_up"))
    return within.join(tops, "_u").select("_b", (F.col("_in") + F.col("_up")).alias("_off"))


def api_batches(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Number the pieces of non-blank texts into calls of 128, in key order, with the position inside the call."""
    wanted = rows.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(key, pieces(F.col(text)).alias("_pieces"))
    numbered = dense_ordinals(wanted.withColumn("_n_pieces", F.size("_pieces")), key, weight="_n_pieces")
    sent = numbered.select(key, "ordinal", F.posexplode("_pieces").alias("piece", text)).withColumn("ordinal", F.col("ordinal") + F.col("piece"))
    batch = F.floor(F.col("ordinal") / F.lit(API_BATCH)).cast("bigint")
    return sent.select(key, "piece", batch.alias("batch"), (F.col("ordinal") - batch * API_BATCH).alias("position"), text)
