"""Registered queries of the pipeline operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proplytics.llm import collocations, decontaminate, hardnegatives, jaccard, languages, licences, mixing, neighbours, packing, pii, quality, sharding, tokencount


#: folder of public tokenizer files, and the pattern that belongs to its byte-level vocabularies
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, and where each goes with a ninth."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return licences.licence_scan(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that give it away."""
    return pii.digest(pii.sanitised(_table(spark, sf_dir, "documents")))


def op4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of whose 5-word shingles it contains 80 % or more."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed 5, 2, 1 to 150 % of all words."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """Unigram token counts of every document."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokencount.Vocabulary.read(vocabulary))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at 3-word shingles and a Jaccard similarity of 0.9."""
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), 3, 90)


def op8_packed(spark: SparkSession, sf_dir: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """All documents as token ids, packed into rows of 2048."""
    return packing.packed(_table(spark, sf_dir, "documents"), packing.Encoder.read(vocabulary, PATTERN), end=50256)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest to every fiftieth vector."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.fit(docs))
    return found.withColumn("langs", F.array_join(F.transform("langs", lambda x: F.concat(x["lang"], F.lit(":"), F.format_number(x["share"], 3))), ","))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return hardnegatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that stand together most."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_licences, op3_pii, op4_leaks, op5_mix, op6_token_counts, op7_jaccard, op8_packed, op9_quality, op10_neighbours,
                                    op11_languages, op12_hard_negatives, op13_collocations)}

#: SQL twins, where SQL can say the whole result.
ORACLES: dict[str, str] = {"op4_leaks": decontaminate.LEAKS_SQL, "op13_collocations": collocations.MINE_SQL,
                           "op12_hard_negatives": hardnegatives.MINE_SQL}
