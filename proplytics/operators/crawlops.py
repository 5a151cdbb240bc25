"""Crawl operations: job statistics, source health, and which crawls are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from proplytics.functions.numbers import duration_label, elapsed_seconds
from proplytics.sources.dimensions import dimension

MAX_CONCURRENT = 3
ACTIVE_STATES = ["pending", "running"]


def latest_completed(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Newest completed job per key.

    A max of structs instead of a ranked window: it combines map-side, so a key with a third
    of all jobs sends one row per task.
    """
    rest = [c for c in jobs.columns if c not in (*keys, "completed_at", "id")]
    pick = F.max(F.struct("completed_at", "id", *rest)).alias("_last")
    done = jobs.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())
    return done.groupBy(*keys).agg(pick).select(*keys, "_last.*")


def source_health(sources: DataFrame, listings: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per source: listing count and last completed crawl. Two aggregates, both a row per source."""
    counts = listings.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("listing_count"))
    last = latest_completed(jobs.select("id", "source_id", "status", "completed_at", "listings_found"), ["source_id"])
    last = last.select(
        F.col("source_id").alias("id"), F.col("completed_at").alias("last_scrape_time"), "listings_found"
    )
    return (
        sources.select("id", "display_name", "is_enabled")
        .join(counts, "id", "left")
        .join(last, "id", "left")
        .withColumn("listing_count", F.coalesce(F.col("listing_count"), F.lit(0).cast("bigint")))
    )


def global_health(properties: DataFrame, jobs: DataFrame) -> DataFrame:
    """Property count beside the newest completed crawl; both sides are one row."""
    total = properties.agg(F.count(F.lit(1)).alias("property_count"))
    done = jobs.where(F.col("status") == "completed")
    last = done.agg(F.max(F.struct("completed_at", "id", "source_id", "listings_found")).alias("_j")).select(
        F.col("_j.source_id").alias("last_source"),
        F.col("_j.completed_at").alias("last_completed_at"),
        F.col("_j.listings_found").alias("last_listings_found"),
    )
    return total.withColumn("_k", F.lit(1)).join(last.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def active_slots(jobs: DataFrame) -> DataFrame:
    """Running or pending jobs and free slots per enabled source."""
    busy = F.count_if(F.col("status").isin(ACTIVE_STATES))
    counts = jobs.groupBy("source_id").agg(busy.alias("active"))
    sources = dimension(jobs.sparkSession, "scrape_sources").where(F.col("is_enabled")).select(
        F.col("id").alias("source_id")
    )
    n = F.coalesce(F.col("active"), F.lit(0).cast("bigint"))
    return sources.join(counts, "source_id", "left").select(
        "source_id", n.alias("active"), F.greatest(F.lit(MAX_CONCURRENT) - n, F.lit(0)).alias("slots")
    )


def freshness(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Latest completed crawl per (source, prefecture) and the seconds since."""
    last = latest_completed(
        jobs.select("id", "source_id", "prefecture_code", "status", "completed_at"), ["source_id", "prefecture_code"]
    )
    return last.select(
        "source_id", "prefecture_code", "id", "completed_at", elapsed_seconds(F.col("completed_at"), as_of).alias("elapsed_s")
    )


def due_crawls(jobs: DataFrame, as_of: Column, interval_hours: float = 6.0) -> DataFrame:
    """Crawls to start now: enabled sources × prefectures, not active, not recent, within free slots.

    Jobs shrink to one row per (source, prefecture) in a single map-side aggregate; the grid of
    sources and prefectures is an exploded array of fixed size (five by 47).
    """
    spark = jobs.sparkSession
    sources = dimension(spark, "scrape_sources").where(F.col("is_enabled"))
    codes = F.transform(F.sequence(F.lit(1), F.lit(47)), lambda i: F.lpad(i.cast("string"), 2, "0"))
    grid = sources.select(F.col("id").alias("source_id"), "config", F.explode(codes).alias("prefecture_code"))
    is_active = F.col("status").isin(ACTIVE_STATES)
    done_at = F.when(F.col("status") == "completed", F.col("completed_at"))
    state = jobs.groupBy("source_id", "prefecture_code").agg(
        F.count_if(is_active).alias("active"), F.max(done_at).alias("last_completed")
    )
    busy = state.groupBy("source_id").agg(F.sum("active").alias("source_active"))
    rows = grid.join(state, ["source_id", "prefecture_code"], "left").join(busy, "source_id", "left")
    zero = F.lit(0).cast("bigint")
    slots = F.lit(MAX_CONCURRENT) - F.coalesce(F.col("source_active"), zero)
    recent = elapsed_seconds(F.col("last_completed"), as_of) < F.lit(interval_hours * 3600.0)
    due = rows.where(
        (F.coalesce(F.col("active"), zero) == 0) & ~F.coalesce(recent, F.lit(False)) & (slots > 0)
    ).withColumn("slots", slots)
    return within_slots(due).select("source_id", "prefecture_code", F.lit("pending").alias("status"), F.col("n").cast("bigint").alias("slot"))


def within_slots(due: DataFrame) -> DataFrame:
    """The first ``slots`` crawls of each source by prefecture, numbered ``n``; a source has 47 prefectures at most."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("prefecture_code"))
    return due.withColumn("n", rank).where(F.col("n") <= F.col("slots"))


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dashboard_counts(jobs: DataFrame) -> DataFrame:
    """Running jobs, and enabled sources beside them."""
    running = jobs.agg(F.count_if(F.col("status") == "running").alias("running_sources")).withColumn("_k", F.lit(1))
    enabled = dimension(jobs.sparkSession, "scrape_sources").agg(
        F.count_if(F.col("is_enabled")).alias("enabled_sources")
    ).withColumn("_k", F.lit(1))
    return enabled.join(running, "_k").drop("_k")


def job_board(jobs: DataFrame) -> DataFrame:
    """Jobs with the names of their source and prefecture (two dimensions of fixed size)."""
    spark = jobs.sparkSession
    sources = dimension(spark, "scrape_sources").select(F.col("id").alias("source_id"), F.col("display_name").alias("source_name"))
    prefectures = dimension(spark, "prefectures").select(
        F.col("code").alias("prefecture_code"), F.col("name_en").alias("prefecture_name")
    )
    return jobs.join(F.broadcast(sources), "source_id", "left").join(F.broadcast(prefectures), "prefecture_code", "left")


def with_duration(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Seconds a job took, or has taken until ``as_of`` while it runs."""
    seconds = elapsed_seconds(F.col("started_at"), F.coalesce(F.col("completed_at"), as_of))
    return jobs.withColumn("seconds", seconds).withColumn(
        "duration", F.coalesce(duration_label(F.col("seconds")), F.lit("-"))
    )


def recent_jobs(jobs: DataFrame, limit: int, source_id: str | None = None, status: str | None = None) -> DataFrame:
    if source_id:
        jobs = jobs.where(F.col("source_id") == source_id)
    if status:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.col("created_at").desc_nulls_first(), F.col("id")).limit(limit)


def fold_job_events(events: DataFrame) -> DataFrame:
    """Current state of each job from its event log: the last status, first start, final counters and error text."""
    carried = ["status", "listings_found", "listings_new", "listings_updated", "error_message"]
    last = F.max_by(F.struct(*carried), F.struct("ts", "event_id"))
    done = F.col("status").isin("completed", "failed")
    return events.groupBy("job_id").agg(
        last.alias("_l"),
        F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(done, F.col("ts"))).alias("finished_at"),
        F.count(F.lit(1)).alias("n_events"),
    ).select("job_id", *[F.col(f"_l.{c}").alias(c) for c in carried], "created_at", "started_at", "finished_at", "n_events")
