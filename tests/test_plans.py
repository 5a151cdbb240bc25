"""The physical plans we rely on."""

from pyspark.sql import functions as F

from proplytics.operators import crawlops, search
from proplytics.operators.search import Filters
from proplytics.plans.registry import Source
from proplytics.sources import schemas


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def stored(spark, tmp_path):
    path = str(tmp_path / "properties")
    spark.createDataFrame([], schemas.PROPERTIES).write.parquet(path)
    return schemas.scan(spark, path, schemas.PROPERTIES)


def test_search_reaches_the_scan(spark, tmp_path):
    rows = search.find(stored(spark, tmp_path), Filters(price_min=1, price_max=9, prefecture_code="13"))
    text = plan(rows.select("id", "price_jpy"))
    for pushed in ("EqualTo(status,active)", "GreaterThanOrEqual(price_jpy,1)", "LessThanOrEqual(price_jpy,9)", "EqualTo(prefecture_code,13)"):
        assert pushed in text
    assert "ReadSchema: struct<id:string,prefecture_code:string,price_jpy:bigint,status:string>" in text


def test_pages_are_a_top_k(spark, tmp_path):
    text = plan(search.page(stored(spark, tmp_path), 2, 50).select("id"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text.replace("TakeOrderedAndProject", "")


def test_latest_job_is_an_aggregate(spark):
    jobs = Source(spark, "/root/testdata/sf0.001").scrape_jobs.withColumn("completed_at", F.col("created_at"))
    text = plan(crawlops.latest_completed(jobs, ["source_id"]))
    assert "Window" not in text and "partial_max" in text


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd="/root/repo", timeout=120).returncode == 0
