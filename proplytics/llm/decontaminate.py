"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items are put into partitions by the number of their shingles. An item's sketch are its lowest shingle hashes, as many as
its partition asks for: a document that contains the wanted share of the item misses fewer shingles than the sketch has, so
one of the sketch is among its own. Sketch hashes are looked up among all shingles of whole documents, whatever their length;
pairs that meet are verified by the share of the item's shingles, as text, that the document contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.llm.common import compact, written

SPLIT = "[^\\p{L}\\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), "")


def shingle_hashes(hashes: Column, k: int) -> Column:
    """A 64-bit hash of every window of ``k`` word hashes."""
    last = F.size(hashes) - k
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(j)) for j in range(k)]))
    return F.when(last >= 0, grams).otherwise(F.expr("cast(array() as array<bigint>)"))


def shingle_texts(words: Column, k: int) -> Column:
    """Every window of ``k`` words as text."""
    last = F.size(words) - k
    grams = F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(last >= 0, grams).otherwise(F.expr("cast(array() as array<string>)"))


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """(item_key, item_id, partition, size, shingles, sketch) of items with a shingle, one row for equal items.

    Partition p holds items of 2^p to 2^(p+1) - 1 shingles; its sketches have what its largest item needs, n - ceil(percent n) + 1.
    """
    rows = items.select(items["item_id"].alias("item_id"), items["text"].alias("text")).distinct()
    rows = rows.withColumn("item_key", F.xxhash64("item_id", "text")).withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("shingles", F.array_distinct(shingle_texts(F.col("words"), k))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("size", F.size("shingles")).where("size > 0").withColumn("partition", F.floor(F.log2("size")).cast("int"))
    largest = (F.pow(F.lit(2.0), F.col("partition") + 1) - 1).cast("int")
    rows = rows.withColumn("keep", largest - F.ceil(largest * percent / 100).cast("int") + 1)
    lowest = F.array_sort(F.array_distinct(shingle_hashes(F.col("hashes"), k)))
    return rows.select("item_key", "item_id", "partition", "size", "shingles", F.slice(lowest, F.lit(1), F.col("keep")).alias("sketch"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[doc_id], docs[text]).alias("doc_key"))


def leaks(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_key, doc_id, item_id, n_shared, n_item of every document and item of which it contains ``percent`` or more.

    Containment counts distinct ``words``-word shingles of lower-cased runs of letters and digits. Items with fewer words have no
    shingle and are never found; null and empty texts contain nothing. Equal rows, of documents or of items, are reported once.
    Empty tables give no rows. Neither table is broadcast by a hint: the planner knows the size of the written sketches.
    """
    known = compact(sketches(items, words, percent))
    rows = _keyed(docs, doc_id, text)
    probes = known.select("item_key", F.explode("sketch").alias("hash"))
    hashes = rows.select("doc_key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    seen = hashes.select("doc_key", F.explode(shingle_hashes(F.col("hashes"), words)).alias("hash"))
    pairs = written(seen.join(compact(probes), "hash").select("doc_key", "item_key").distinct())
    texts = rows.join(pairs, "doc_key").dropDuplicates(["doc_key", "item_key"]).withColumn("words", words_of(F.col("text")))
    found = texts.select("doc_key", "doc_id", "item_key", shingle_texts(F.col("words"), words).alias("grams")).join(known, "item_key")
    found = found.withColumn("n_shared", F.size(F.array_intersect("shingles", "grams")))
    found = found.where(F.col("n_shared") * 100 >= F.col("size") * percent)
    return found.select("doc_key", "doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("size").cast("long").alias("n_item"))


def clean_documents(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that contain no item."""
    found = compact(leaks(docs, items, words, percent, doc_id, text).select("doc_key").distinct())
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(docs[doc_id], docs[text]).alias("doc_key"))
    return packed.join(found, "doc_key", "left_anti").select("row.*")


LEAKS_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
     b AS (SELECT DISTINCT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d),
     bs AS (SELECT DISTINCT item_id, text, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b),
     n AS (SELECT item_id, text, count(*) AS n_item FROM bs GROUP BY ALL)
SELECT ds.doc_id, bs.item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM ds JOIN bs USING (s) JOIN n ON n.item_id IS NOT DISTINCT FROM bs.item_id AND n.text IS NOT DISTINCT FROM bs.text
GROUP BY ds.doc_id, ds.text, bs.item_id, bs.text HAVING count(*) * 100 >= any_value(n_item) * 80
"""
