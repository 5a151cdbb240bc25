"""Structured Streaming jobs over the listing feed and the job log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from proplytics.operators import ingest
from proplytics.session import materialise
from proplytics.sources import schemas

LISTING_LOG_KEY = ["source_id", "source_listing_id"]


def feed_stream(spark: SparkSession, path: str, schema: str = schemas.LISTING, files_per_batch: int = 1000) -> DataFrame:
    """Landed files as a stream, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(frame: DataFrame, load, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run everything available now through ``load(batch, batch_id)`` and stop."""
    query = (
        frame.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(load)
        .start()
    )
    query.awaitTermination()
    return query


# --- the property store: one append-only log per table ----------------------------


class Store:
    """Property tables as logs of row versions, one folder per loaded batch.

    A batch writes only the rows it touches, into the folder of its own number, and reads only
    folders before it. A batch that is run again after a failure therefore sees the same input
    and replaces its own output.
    """

    TABLES = {
        "properties": (schemas.PROPERTIES, ["id"]),
        "listings": (schemas.PROPERTY_LISTINGS, LISTING_LOG_KEY),
        "images": (schemas.PROPERTY_IMAGES, ["property_id", "storage_path"]),
        "scores": ("property_id string, rebuild_score double, hazard_score double, infrastructure_score double, "
                   "demographic_score double, value_score double, condition_score double, composite_score double, "
                   "scoring_version string", ["property_id", "scoring_version"]),
        "hazards": ("property_id string, assessed_at timestamp_ntz", ["property_id"]),
        "outcomes": ("source string, source_id string, property_id string, is_new boolean", ["source", "source_id"]),
        "quarantine": (schemas.LISTING + ", fault string", []),
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, (schema, _) in self.TABLES.items():
            start = self.spark.createDataFrame([], schema)
            start.write.mode("ignore").parquet(f"{self.path}/{name}/v=0")

    def log(self, table: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.TABLES[table][0]}, v bigint").option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        return rows if before is None else rows.where(F.col("v") < before)

    def latest(self, table: str, rows: DataFrame | None = None) -> DataFrame:
        """Last version of each row."""
        keys = self.TABLES[table][1]
        rows = self.log(table) if rows is None else rows
        rest = [c for c in rows.columns if c not in (*keys, "v")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "v").alias("_r")).select(*keys, "_r.*")

    def write(self, table: str, rows: DataFrame, version: int) -> None:
        schema = self.spark.createDataFrame([], self.TABLES[table][0]).schema
        have = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        rows.select(*have).write.mode("overwrite").parquet(f"{self.path}/{table}/v={version}")

    def load(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: faults to quarantine, the rest resolved and merged.

        Stored rows are fetched by semi joins with the batch's own keys and addresses, small
        sides both; the big tables are scanned in few columns and never shuffled.
        """
        version = batch_id + 1
        good, bad = ingest.split_valid(batch)
        folded = materialise(ingest.fold_listings(good))
        keys = folded.select(F.col("source").alias("source_id"), F.col("source_id").alias("source_listing_id"))
        listings = materialise(self.latest("listings", self.log("listings", version).join(keys, LISTING_LOG_KEY, "left_semi")))
        stored = self.log("properties", version)
        named = folded.where(F.col("address").isNotNull()).select(F.col("address").alias("address_ja")).distinct()
        wanted = (
            stored.join(named, "address_ja", "left_semi").select("id")
            .unionByName(listings.select(F.col("property_id").alias("id"))).distinct()
        )
        properties = materialise(self.latest("properties", stored.join(wanted, "id", "left_semi")))
        # the time of a batch is that of its latest row, so that a batch run again writes the same
        as_of = F.lit(folded.agg(F.max("scraped_at")).first()[0]).cast("timestamp_ntz")
        out = ingest.apply_batch(folded, listings, properties, as_of)
        self.write("properties", out.properties, version)
        self.write("listings", out.listings, version)
        self.write("images", out.images, version)
        self.write("scores", out.scores, version)
        self.write("hazards", out.hazards, version)
        self.write("outcomes", out.outcomes, version)
        self.write("quarantine", bad, version)

    def compact(self, target: str) -> "Store":
        """A new store whose first version is the latest state of this one."""
        fresh = Store(self.spark, target)
        for table, (_, keys) in self.TABLES.items():
            fresh.write(table, self.latest(table) if keys else self.log(table).drop("v"), 0)
        return fresh


def run_feed_upsert(spark: SparkSession, feed_path: str, store_path: str, checkpoint: str, files_per_batch: int = 1000) -> Store:
    """Load every landed feed file not loaded yet."""
    store = Store(spark, store_path)
    drain(feed_stream(spark, feed_path, files_per_batch=files_per_batch), store.load, checkpoint)
    return store


# --- deduplication, throughput, freshness -------------------------------------------


def first_deliveries(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a listing that arrive within the watermark; state older than it is freed."""
    timed = feed.withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    return timed.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["source", "source_id"])


def throughput(jobs: DataFrame, width: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Jobs and listings per source and tumbling window of event time."""
    timed = jobs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    grouped = timed.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "source_id")
    return grouped.agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.sum("listings_found").alias("listings_found"),
    ).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "source_id", "jobs", "completed", "listings_found")


def freshness(jobs: DataFrame) -> DataFrame:
    """Newest completed crawl per (source, prefecture); the state is one row per pair."""
    done = jobs.where(F.col("status") == "completed")
    return done.groupBy("source_id", "prefecture_code").agg(F.max("created_at").alias("last_completed"))


def updates_to_table(frame: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Drain an updating aggregate into versioned folders and read the last version of each key."""
    spark = frame.sparkSession
    out = f"{path.rstrip('/')}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/v={batch_id}")

    drain(frame, write, f"{path.rstrip('/')}/checkpoint", "update")
    rows = spark.read.schema(StructType([*frame.schema.fields, StructField("v", LongType())])).option("basePath", out).parquet(out)
    rest = [c for c in frame.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "v").alias("_r")).select(*keys, "_r.*")
