"""Deal pipeline: creation, patches, checklist progress and stage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.sources.dimensions import CHECKLIST, DEAL_STAGES, dimension

STAGES = [s for s, _, _ in DEAL_STAGES]
TERMINAL = [s for s, _, terminal in DEAL_STAGES if terminal]


def active_deals(deals: DataFrame) -> DataFrame:
    return deals.where(~F.col("stage").isin(TERMINAL))


def valid_stage(stage: Column) -> Column:
    return stage.isin(STAGES)


def stage_counts(deals: DataFrame) -> DataFrame:
    """Deals per stage in pipeline order, empty stages with 0."""
    counts = deals.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return dimension(deals.sparkSession, "deal_stages").join(counts, "stage", "left").select(
        "stage_order", "stage", "label", "terminal", F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("n")
    )


def stage_breakdown(deals: DataFrame) -> DataFrame:
    """``2 in analysis, 1 in sale`` over active stages that hold deals."""
    rows = stage_counts(deals).where(~F.col("terminal") & (F.col("n") > 0))
    part = F.concat(F.col("n").cast("string"), F.lit(" in "), F.lower("label"))
    # ten rows at most: the aggregate above has already shrunk the table
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("stage_order", part.alias("part")))), lambda s: s["part"]), ", "
    )
    return rows.agg(joined.alias("_t")).select(
        F.coalesce(F.nullif(F.col("_t"), F.lit("")), F.lit("No active deals")).alias("breakdown")
    )


def terminal_total(deals: DataFrame) -> DataFrame:
    return deals.agg(F.count_if(F.col("stage").isin(TERMINAL)).alias("terminal_count"))


def profit(purchase: Column, renovation: Column, target: Column) -> dict[str, Column]:
    """Gross profit and margin on cost; margin is 0 without cost."""
    zero = F.lit(0).cast("bigint")
    cost = F.coalesce(purchase, zero) + F.coalesce(renovation, zero)
    gain = F.coalesce(target, zero) - cost
    margin = F.when(cost > 0, gain.cast("double") / cost * F.lit(100.0)).otherwise(F.lit(0.0))
    return {"total_cost": cost, "gross_profit": gain, "margin_pct": margin}


def new_deals(requests: DataFrame, as_of: Column) -> DataFrame:
    """Deals in the first stage from requests(id, property_id, purchase_price, notes)."""
    return requests.withColumns({"stage": F.lit(STAGES[0]), "created_at": as_of, "updated_at": as_of})


def checklist_items(deals: DataFrame) -> DataFrame:
    """The default checklist of every deal: an in-place explode of a fixed array, no join."""
    item = [
        F.struct(F.lit(c).alias("category"), F.lit(n).alias("item_name"), F.lit(d).alias("description"))
        for c, n, d in CHECKLIST
    ]
    rows = deals.select(F.col("id").alias("deal_id"), F.posexplode(F.array(*item)).alias("sort_order", "_i"))
    return rows.select("deal_id", "sort_order", "_i.*", F.lit(False).alias("is_completed"))


def patch_deals(deals: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Overwrite what a patch names; patches have one row per deal, stage already checked."""
    fields = [c for c in patches.columns if c != "id"]
    side = patches.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = deals.join(side, "id", "left")
    picks = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}
    if "updated_at" in deals.columns:
        picks["updated_at"] = F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))
    return joined.withColumns(picks).select(*deals.columns)


def toggle_items(items: DataFrame, toggles: DataFrame, as_of: Column) -> DataFrame:
    """Set or clear completion of the items in toggles(deal_id, item_name, is_completed, notes)."""
    side = toggles.select("deal_id", "item_name", F.col("is_completed").alias("_done"), F.col("notes").alias("_notes"))
    joined = items.join(side, ["deal_id", "item_name"], "left")
    hit = F.col("_done").isNotNull()
    return joined.select(
        *[c for c in items.columns if c not in ("is_completed", "completed_at", "notes")],
        F.coalesce(F.col("_done"), F.col("is_completed")).alias("is_completed"),
        F.when(hit & F.col("_done"), as_of).when(hit, F.lit(None)).otherwise(F.col("completed_at")).alias("completed_at"),
        F.coalesce(F.col("_notes"), F.col("notes")).alias("notes"),
    )


def checklist_progress(items: DataFrame) -> DataFrame:
    """Completed and total items per deal and category, and per deal (category null)."""
    return (
        items.groupBy(F.col("deal_id"), F.col("category"))
        .agg(F.count_if("is_completed").alias("completed"), F.count(F.lit(1)).alias("total"))
        .rollup("deal_id", "category")
        .agg(F.sum("completed").alias("completed"), F.sum("total").alias("total"))
        .where(F.col("deal_id").isNotNull())
        .withColumn("pct", F.col("completed").cast("double") / F.col("total") * F.lit(100.0))
    )


def first_deal(deals: DataFrame) -> DataFrame:
    """First deal of each property."""
    return deals.groupBy("property_id").agg(F.min("id").alias("deal_id"))


def with_deal(properties: DataFrame, deals: DataFrame) -> DataFrame:
    side = first_deal(deals).withColumnRenamed("property_id", "id")
    return properties.join(side, "id", "left").withColumn("has_deal", F.col("deal_id").isNotNull())
