"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a new shard only takes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.llm.common import dense_slots

#: Multiplier of the method's linear congruential generator: a fixed value.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: jump forward through shard counts until the next jump passes ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    found = np.zeros(len(state), np.int32)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        found[live] = at[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        at[live] = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / step)).astype(np.int64)
        live = live[at[live] < shards]
    return found


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards`` - 1 of an integer key."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards))

    return place(key)


def stable_key(column: Column) -> Column:
    """The 64-bit key of any column: its xxhash64; null has a key like any other value."""
    return F.xxhash64(column)


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", blocks: int = 1024) -> DataFrame:
    """Place every row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The key column alone decides: a null key has one fixed shard, equal keys share one, whatever their texts.
    ``size`` is the text's UTF-8 length plus 1; a null text has no bytes and a null ``text_crc32``, an empty one crc32 0.
    ``slot`` numbers the rows of a shard from 0; equal rows are counted first and numbered together. ``grown_shard`` is the
    shard with one more: either the old one or the new one. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    rows = docs.select(
        docs[key].alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(docs[text]).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    counted = counted.withColumn("shard", shard_of(stable_key(F.col("doc_id")), shards))
    counted = counted.withColumn("grown_shard", shard_of(stable_key(F.col("doc_id")), shards + 1))
    placed = dense_slots(counted, "shard", ["doc_id", "size", "text_crc32"], blocks)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """(row, shard): every row whole, as a struct, with its shard; for ``write_shards``."""
    return docs.select(F.struct(*docs.columns).alias("row"), shard_of(stable_key(docs[key]), shards).alias("shard"))


def write_shards(docs: DataFrame, path: str, shards: int, files: int = 1, key: str = "doc_id") -> None:
    """Write ``docs`` below ``path`` in one folder per shard (``shard=0`` ...), each dealt over ``files`` writers by row hash."""
    rows = shard_rows(docs, shards, key)
    salt = F.pmod(F.xxhash64(F.to_json("row")), F.lit(files))
    rows.repartition(shards * files, "shard", salt).write.partitionBy("shard").parquet(path)
