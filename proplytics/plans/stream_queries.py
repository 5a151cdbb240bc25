"""Queries run as streams over the landed tables; their twins are the batch equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proplytics.plans.registry import query
from proplytics.plans.twins import over
from proplytics.session import shared_dir
from proplytics.sources.schemas import BASE
from proplytics.streaming import jobs


def _work(s, name: str) -> str:
    return f"{shared_dir(s.spark).rstrip('/')}/proplytics-streams/{name}-{uuid.uuid4().hex}"


def _stream(s, table: str, columns: list[str]):
    """The landed file as a stream, projected as in the batch view."""
    files = s.spark.readStream.schema(BASE[table]).option("pathGlobFilter", f"{table}.parquet")
    return files.parquet(s.sf_dir).selectExpr(*columns)


JOBS = [
    "event_id AS id",
    "CASE user_id % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source_id",
    "lpad(CAST(user_id % 47 + 1 AS STRING), 2, '0') AS prefecture_code",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'pending' ELSE 'completed' END AS status",
    "ts AS created_at",
    "CAST(floor(value) AS INT) AS listings_found",
]


@query(
    "str03_crawl_throughput",
    over("scrape_jobs", sql="""SELECT time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') AS window_start, source_id, count(*) AS jobs,
 count(*) FILTER (status = 'completed') AS completed, CAST(sum(listings_found) AS BIGINT) AS listings_found FROM scrape_jobs GROUP BY ALL"""),
)
def _throughput(s):
    return jobs.updates_to_table(jobs.throughput(_stream(s, "events", JOBS)), ["window_start", "source_id"], _work(s, "throughput"))


@query(
    "str04_freshness",
    over("scrape_jobs", sql="SELECT source_id, prefecture_code, max(created_at) AS last_completed FROM scrape_jobs WHERE status = 'completed' GROUP BY ALL"),
)
def _freshness(s):
    return jobs.updates_to_table(jobs.freshness(_stream(s, "events", JOBS)), ["source_id", "prefecture_code"], _work(s, "freshness"))


FEED = [
    "CASE l_linenumber % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source",
    "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS source_id",
    "l_shipdate AS scraped_at",
]


@query(
    "str02_first_deliveries",
    over("listing_feed", sql="SELECT DISTINCT source, source_id FROM listing_feed"),
)
def _deliveries(s):
    frame = jobs.first_deliveries(_stream(s, "lineitem", FEED)).select("source", "source_id")
    out = _work(s, "deliveries")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/rows/v={batch_id}")

    jobs.drain(frame, write, f"{out}/checkpoint")
    return s.spark.read.schema("source string, source_id string, v bigint").option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("v")


@query(
    "str01_feed_upsert",
    """SELECT source, count(*) AS listings, count(DISTINCT p) AS properties, CAST(sum(price) AS BIGINT) AS price FROM (
 SELECT CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END AS source,
  o_custkey AS p, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) GROUP BY source""",
)
def _upsert(s):
    """Every order as a listing of its customer's address, loaded through the streaming store."""
    from proplytics.sources import schemas

    columns = {
        "source": "CASE o_orderkey % 5 WHEN 0 THEN 'suumo' WHEN 1 THEN 'homes' WHEN 2 THEN 'athome' WHEN 3 THEN 'akiya' ELSE 'bit' END",
        "source_id": "CAST(o_orderkey AS STRING)",
        "source_url": "concat('https://portal.example/', CAST(o_orderkey AS STRING))",
        "price": "CAST(floor(o_totalprice) AS BIGINT)",
        "address": "concat('長野県松本市中央', CAST(o_custkey AS STRING))",
        "raw_data": "map('price', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING))",
        "scraped_at": "o_orderdate",
    }
    fields = [part.strip().rsplit(" ", 1) for part in schemas.LISTING.replace("map<string,string>", "map<string;string>").split(",")]
    exprs = [f"CAST({columns.get(n, 'NULL')} AS {t.replace(';', ',')}) AS {n}" for n, t in fields]
    path = _work(s, "upsert")
    store = jobs.Store(s.spark, f"{path}/store")
    jobs.drain(_stream(s, "orders", exprs), store.load, f"{path}/checkpoint")
    rows = store.latest("listings")
    return rows.groupBy(F.col("source_id").alias("source")).agg(
        F.count(F.lit(1)).alias("listings"),
        F.countDistinct("property_id").alias("properties"),
        F.sum(F.try_element_at("raw_data_json", F.lit("price")).cast("bigint")).alias("price"),
    )
