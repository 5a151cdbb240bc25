"""Acquisition cost and return projection over rows of properties, deals or scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proplytics.functions import tax
from proplytics.functions.numbers import round_exact
from proplytics.sources.dimensions import dimension


def with_commission(df: DataFrame, price: str = "price") -> DataFrame:
    p = F.col(price)
    return df.withColumns(
        {
            "standard_excl_tax": tax.yen(tax.commission_standard(p)),
            "standard_incl_tax": tax.commission_with_tax(p),
            "low_price_rule_applies": p <= tax.LOW_PRICE_THRESHOLD,
            "actual_commission_incl_tax": tax.commission(p),
        }
    )


def with_registration_tax(df: DataFrame, assessed: str = "assessed_value", land_only: Column = None) -> DataFrame:
    flag = F.lit(False) if land_only is None else land_only
    a = F.col(assessed)
    return df.withColumns(
        {
            "registration_land": tax.registration_land(a, flag),
            "registration_building": tax.registration_building(a, flag),
        }
    ).withColumn("registration_total", F.col("registration_land") + F.col("registration_building"))


def with_acquisition_tax(df: DataFrame, assessed: str = "assessed_value", land_only: Column = None) -> DataFrame:
    flag = F.lit(False) if land_only is None else land_only
    a = F.col(assessed)
    return df.withColumns(
        {"acquisition_land": tax.acquisition_land(a, flag), "acquisition_building": tax.acquisition_building(a, flag)}
    ).withColumn("acquisition_total", F.col("acquisition_land") + F.col("acquisition_building"))


def with_holding_cost(df: DataFrame, assessed: str = "assessed_value") -> DataFrame:
    a = F.col(assessed)
    return df.withColumns(
        {
            "fixed_asset_tax": tax.yen(a * F.lit(tax.FIXED_ASSET_TAX)),
            "city_planning_tax": tax.yen(a * F.lit(tax.CITY_PLANNING_TAX)),
            "total_annual": tax.annual_holding(a),
            "monthly": tax.monthly_holding(a),
        }
    )


def with_capital_gains(
    df: DataFrame,
    sale: str = "sale_price",
    cost: str = "acquisition_cost",
    sale_costs: str = "sale_costs",
    months: str = "holding_months",
) -> DataFrame:
    gain, m = F.col(sale) - F.col(cost) - F.col(sale_costs), F.col(months)
    return (
        df.withColumn("taxable_gain", gain)
        .withColumns(
            {
                "tax_rate": tax.gains_rate(F.col("taxable_gain"), m),
                "tax_amount": tax.gains_tax(F.col("taxable_gain"), m),
                "is_short_term": m <= tax.SHORT_TERM_MONTHS,
            }
        )
        .withColumns(
            {
                # without a price or a cost nothing is known
                "tax_rate": F.when(gain.isNotNull(), F.col("tax_rate")),
                "tax_amount": F.when(gain.isNotNull(), F.col("tax_amount")),
                "taxable_gain": F.when(gain.isNotNull(), F.greatest(F.lit(0).cast("bigint"), gain)),
                "net_after_tax": F.when(gain.isNotNull(), F.col(sale) - F.col(sale_costs) - F.col("tax_amount")),
            }
        )
    )


def with_purchase_costs(
    df: DataFrame, price: str = "price", assessed: str | None = None, land_only: Column | None = None
) -> DataFrame:
    """Every cost of buying at ``price``; a missing assessed value is 70 % of it."""
    p = F.col(price)
    given = F.col(assessed) if assessed else F.lit(None).cast("bigint")
    df = df.withColumn("assessed_value_used", F.coalesce(given, tax.default_assessed(p)))
    df = with_registration_tax(df, "assessed_value_used", land_only)
    df = with_acquisition_tax(df, "assessed_value_used", land_only)
    return (
        df.withColumns(
            {
                "commission": tax.commission(p),
                "stamp_tax": tax.stamp_tax(p),
                "scrivener_fee": F.lit(tax.SCRIVENER_FEE).cast("bigint"),
            }
        )
        .withColumn(
            "total_purchase_costs",
            F.col("commission")
            + F.col("stamp_tax")
            + F.col("registration_total")
            + F.col("acquisition_total")
            + F.col("scrivener_fee"),
        )
        .withColumns(
            {
                "total_with_price": p + F.col("total_purchase_costs"),
                "cost_ratio": F.when(
                    p > 0, round_exact(F.col("total_purchase_costs").cast("double") / p * F.lit(100.0), 1)
                ).otherwise(F.lit(0.0)),
            }
        )
    )


def with_roi(
    df: DataFrame,
    price: str = "purchase_price",
    assessed: str | None = None,
    renovation: str = "renovation_budget",
    target: str = "target_sale_price",
    months: str = "holding_months",
) -> DataFrame:
    """Buy, renovate, hold and sell: invested, net profit, return and break-even price.

    An assessed value of zero counts as zero for the purchase taxes but is replaced by the
    default for the holding cost.
    """
    p = F.col(price)
    zero = F.lit(0).cast("bigint")
    given = F.col(assessed) if assessed else F.lit(None).cast("bigint")
    df = with_purchase_costs(df, price, assessed)
    df = df.withColumns(
        {
            "_reno": F.coalesce(F.col(renovation), zero),
            "_target": F.coalesce(F.col(target), zero),
            "_months": F.coalesce(F.col(months), F.lit(12)),
            "holding_monthly": tax.monthly_holding(F.coalesce(F.nullif(given, zero), tax.default_assessed(p))),
        }
    )
    df = df.withColumns(
        {
            "holding_costs": F.col("holding_monthly") * F.col("_months"),
            "sale_commission": tax.commission(F.col("_target")),
        }
    ).withColumn("total_invested", F.col("total_with_price") + F.col("_reno") + F.col("holding_costs"))
    df = df.withColumn("_gain", F.col("_target") - F.col("total_with_price") - F.col("_reno") - F.col("sale_commission"))
    df = df.withColumns(
        {
            "capital_gains_tax": tax.gains_tax(F.col("_gain"), F.col("_months")),
            "tax_rate": tax.gains_rate(F.col("_gain"), F.col("_months")),
        }
    ).withColumn("net_proceeds", F.col("_target") - F.col("sale_commission") - F.col("capital_gains_tax"))
    df = df.withColumn("net_profit", F.col("net_proceeds") - F.col("total_invested"))
    df = df.withColumn(
        "roi_percent",
        F.when(
            F.col("total_invested") > 0,
            round_exact(F.col("net_profit").cast("double") / F.col("total_invested") * F.lit(100.0), 1),
        ).otherwise(F.lit(0.0)),
    )
    return df.withColumns(
        {
            "annualized_roi_percent": round_exact(
                F.col("roi_percent") / F.greatest(F.col("_months"), F.lit(1)) * F.lit(12.0), 1
            ),
            "breakeven_sale_price": F.ceil(
                (F.col("total_invested") + F.col("sale_commission")).cast("double") / (F.lit(1.0) - F.col("tax_rate"))
            ).cast("bigint"),
        }
    ).drop("_reno", "_target", "_months", "_gain")


def with_rate(df: DataFrame, tax_name: str, amount: str, names: dict[str, str]) -> DataFrame:
    """``df`` with columns of the rate table's bracket that ``amount`` falls in; ``names`` maps table columns to new ones.

    The table is a fixed dimension of under 50 rows, joined on the tax with the bracket as a condition; null amounts get nulls.
    """
    rates = dimension(df.sparkSession, "rates").where(F.col("tax") == tax_name).select(
        F.col("tax").alias("_tax"), F.col("low").alias("_low"), F.col("high").alias("_high"), *[F.col(c).alias(n) for c, n in names.items()])
    inside = (F.col(amount) > F.col("_low")) & (F.col("_high").isNull() | (F.col(amount) <= F.col("_high")))
    rows = df.withColumn("_of", F.when(F.col(amount).isNotNull(), F.lit(tax_name)))
    return rows.join(F.broadcast(rates), (F.col("_of") == F.col("_tax")) & inside, "left").drop("_of", "_tax", "_low", "_high")


def scenario_grid(df: DataFrame, scenarios: list[tuple], columns: dict[str, str]) -> DataFrame:
    """Every property against the scenarios the caller names: tuples in the order of ``columns`` (name → type).

    Scenarios are parameters, carried as one array literal and exploded, so each row fans out in place without a join.
    """
    items = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, columns.items())]) for r in scenarios]
    return df.withColumn("_s", F.explode(F.array(*items))).select(*df.columns, "_s.*")


def _structure_percent(structure: Column) -> Column:
    """Cost of building by structure, in percent of that of wood; unknown structures count as wood."""
    s = F.coalesce(structure, F.lit(""))
    return F.when(s.contains("軽量鉄骨"), 110).when(s.contains("鉄筋") | s.contains("RC"), 140).when(s.contains("鉄骨"), 120).otherwise(100)


def renovation_estimate(houses: DataFrame, year: int, costs: DataFrame | None = None) -> DataFrame:
    """Houses (building_area_sqm, year_built, structure, rebuild_possible) with what each kind of work costs: work, least, most, is_advised.

    ``costs`` are bands of floor area (work, area_from, area_below, least, most), by default the fixed table; amounts grow with the
    structure. Up to 15 years a refresh is advised, beyond 45 years rebuilding where that is known to be possible, else and of unknown
    age a full renovation. A house without an area, or with one that no band holds, has one row without work and amounts.
    """
    from proplytics.operators.ranges import band_join

    costs = dimension(houses.sparkSession, "renovation_costs") if costs is None else costs
    rows = band_join(houses, costs, "building_area_sqm", "area_from", "area_below", [])
    age, percent = F.lit(year) - F.col("year_built"), _structure_percent(F.col("structure"))
    advised = F.when(age <= 15, "basic").when((age > 45) & F.col("rebuild_possible"), "rebuild").otherwise("full")
    amounts = {c: F.floor(F.col(c) * percent / 100).cast("bigint") for c in ("least", "most")}
    return rows.withColumns(amounts).withColumn("is_advised", F.col("work") == advised).drop("area_from", "area_below")
