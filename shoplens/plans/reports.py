"""Report tables behind the dashboard and the exploration of whole tables.

Sales reports take sales lines (``revenue``, ``orders``, ``rows`` and the key columns, see
:mod:`shoplens.operators.slicing`); customer reports take segmented customers. A missing group
key belongs to no group. Money is added up as decimals and turned into doubles at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoplens.functions.columns import dollars, grouped_number, money_sum, plain_number

# Fixed value of the dashboard: a churn rate above it is shown as an alert.
CHURN_ALERT_ABOVE = 20
TOP_PRODUCTS = 10


# Keys of every sales report; those of the key figures are one line per customer.
SALES_REPORTS = {
    "monthly_revenue": ["year_month"],
    "payment_split": ["payment_method"],
    "category_performance": ["product_category"],
    "top_products": ["product_category", "product_name"],
    "revenue_by_location": ["location"],
    "kpi_cards": ["customer_id", "churn_status"],
}


def sales_summary(sales: DataFrame) -> DataFrame:
    """Sales lines added up by the keys of every sales report in one scan: ``report``, all keys, the sums.

    One aggregate over grouping sets; a task sends a line per report and key it has. Few lines per report
    but for the key figures, so write it partitioned by ``report`` and take each with :func:`of_report`.
    """
    keys = list(dict.fromkeys(key for own in SALES_REPORTS.values() for key in own))
    # The grouping id has a bit per key, the last key the lowest, set where a report lacks the key.
    ids = {sum(1 << i for i, key in enumerate(reversed(keys)) if key not in own): name for name, own in SALES_REPORTS.items()}
    name_of = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    summed = sales.groupingSets([[F.col(key) for key in own] for own in SALES_REPORTS.values()], *keys).agg(
        F.grouping_id().alias("_set"),
        money_sum(F.col("revenue")).alias("revenue"),
        F.sum("orders").alias("orders"),
        F.sum("rows").alias("rows"),
    )
    return summed.select(name_of[F.col("_set").cast("int")].alias("report"), *keys, "revenue", "orders", "rows")


def of_report(summary: DataFrame, report: str) -> DataFrame:
    """The lines that one report takes as its sales: its keys and the sums."""
    return summary.where(F.col("report") == report).select(*SALES_REPORTS[report], "revenue", "orders", "rows")


def _present(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def revenue_by(sales: DataFrame, *keys: str) -> DataFrame:
    return _present(sales, *keys).groupBy(*keys).agg(money_sum(F.col("revenue")).alias("revenue"))


def _as_double(df: DataFrame, column: str = "revenue") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("double"))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return _as_double(revenue_by(sales, "year_month")).orderBy("year_month")


def revenue_by_season(sales: DataFrame) -> DataFrame:
    return _as_double(revenue_by(sales, "season")).orderBy("season")


def payment_split(sales: DataFrame) -> DataFrame:
    """Revenue and share of the total per payment method."""
    per_method = revenue_by(sales, "payment_method")
    # The window runs over one line per payment method.
    total = F.sum("revenue").over(Window.partitionBy())
    share = F.coalesce(F.try_divide(F.col("revenue").cast("double"), total.cast("double")), F.lit(0.0)) * 100
    return per_method.select(
        "payment_method", F.col("revenue").cast("double").alias("revenue"), share.alias("share_pct")
    ).orderBy("payment_method")


def revenue_by_location(sales: DataFrame) -> DataFrame:
    return _as_double(revenue_by(sales, "location")).orderBy("revenue", "location")


def category_performance(sales: DataFrame) -> DataFrame:
    return _as_double(
        _present(sales, "product_category")
        .groupBy("product_category")
        .agg(money_sum(F.col("revenue")).alias("revenue"), F.sum("orders").alias("orders"))
    ).orderBy(F.desc("revenue"), "product_category")


def category_table(sales: DataFrame) -> DataFrame:
    """Category performance as shown: ``$1,234.56`` and ``1,234``."""
    return category_performance(sales).select(
        "product_category",
        dollars(F.col("revenue")).alias("revenue"),
        grouped_number(F.col("orders"), 0).alias("orders"),
    )


def top_products(sales: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    per_product = _as_double(revenue_by(sales, "product_category", "product_name"))
    return per_product.orderBy(F.desc("revenue"), "product_category", "product_name").limit(k)


def kpi_cards(sales: DataFrame) -> DataFrame:
    """One line of key figures from sales lines that carry ``customer_id`` and ``churn_status``.

    One line per customer comes first, so that counting lines counts distinct customers; lines
    that are partitioned by customer already are not moved for it.
    """
    per_customer = sales.groupBy("customer_id", "churn_status").agg(
        money_sum(F.col("revenue")).alias("revenue"), F.sum("rows").alias("rows")
    )
    totals = per_customer.agg(
        money_sum(F.col("revenue")).cast("double").alias("total_revenue"),
        F.count("*").alias("active_customers"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_orders"),
        F.count_if(F.col("churn_status") == "Churned").alias("churned_customers"),
    )

    def ratio(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return totals.withColumns(
        {
            "avg_order_value": ratio("total_revenue", "total_orders"),
            "churn_rate": ratio("churned_customers", "active_customers") * 100,
        }
    ).withColumn("churn_alert", F.col("churn_rate") > CHURN_ALERT_ABOVE)


def kpi_cards_formatted(sales: DataFrame) -> DataFrame:
    return kpi_cards(sales).select(
        dollars(F.col("total_revenue")).alias("total_revenue"),
        grouped_number(F.col("active_customers"), 0).alias("active_customers"),
        F.concat(F.lit("$"), plain_number(F.col("avg_order_value"), 2)).alias("avg_order_value"),
        F.concat(plain_number(F.col("churn_rate"), 1), F.lit("%")).alias("churn_rate"),
        F.concat(F.col("churned_customers").cast("string"), F.lit(" customers at risk")).alias("churn_note"),
        "churn_alert",
    )


def filter_options(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Sorted choices of the category and location filters."""
    categories = transactions.select(F.lit("category").alias("kind"), F.col("product_category").alias("value"))
    locations = customers.select(F.lit("location").alias("kind"), F.col("location").alias("value"))
    return categories.distinct().unionByName(locations.distinct()).orderBy("kind", "value")


def count_by(customers: DataFrame, key: str, count: str = "customers") -> DataFrame:
    return (
        _present(customers, key)
        .groupBy(key)
        .agg(F.count("customer_id").alias(count))
        .orderBy(F.desc(count), key)
    )


def rfm_distribution(customers: DataFrame) -> DataFrame:
    return count_by(customers, "rfm_segment")


def cluster_distribution(customers: DataFrame) -> DataFrame:
    return count_by(customers, "cluster_name")


def location_distribution(customers: DataFrame) -> DataFrame:
    return count_by(customers, "location")


def satisfaction_distribution(customers: DataFrame) -> DataFrame:
    return count_by(customers, "satisfaction_score").orderBy("satisfaction_score")


def gender_distribution(customers: DataFrame) -> DataFrame:
    """Customers per gender with their share, also as shown: ``12.3%``."""
    counts = count_by(customers, "gender")
    # The window runs over one line per gender.
    share = F.col("customers") / F.sum("customers").over(Window.partitionBy()) * 100
    return (
        counts.withColumn("share_pct", share)
        .withColumn("share_label", F.concat(plain_number(F.col("share_pct"), 1), F.lit("%")))
        .orderBy(F.desc("customers"), "gender")
    )


def _mean_money(column: str) -> Column:
    # Revenue has eight decimals, and so have sums of it; adding them as decimals does not depend on row order.
    total = F.sum(F.col(column).cast("decimal(38,8)"))
    return F.try_divide(total.cast("double"), F.count(column).cast("double"))


def _mean_int(column: str) -> Column:
    return F.try_divide(F.sum(column).cast("double"), F.count(column).cast("double"))


def rfm_segment_metrics(customers: DataFrame) -> DataFrame:
    return (
        _present(customers, "rfm_segment")
        .groupBy("rfm_segment")
        .agg(
            _mean_money("total_spend").alias("avg_spend"),
            _mean_int("recency_days").alias("avg_recency"),
            F.count("customer_id").alias("customers"),
        )
        .orderBy(F.desc("avg_spend"), "rfm_segment")
    )


def cluster_profile(customers: DataFrame) -> DataFrame:
    return (
        _present(customers, "cluster_name")
        .groupBy("cluster_name")
        .agg(
            F.count("customer_id").alias("customers"),
            _mean_money("total_spend").alias("avg_spend"),
            _mean_int("total_transactions").alias("avg_frequency"),
            _mean_int("recency_days").alias("avg_recency"),
            _mean_int("annual_income").alias("avg_income"),
            _mean_int("age").alias("avg_age"),
            _mean_int("satisfaction_score").alias("avg_satisfaction"),
        )
        .orderBy(F.desc("avg_spend"), "cluster_name")
    )


def cluster_profile_formatted(customers: DataFrame) -> DataFrame:
    def shown(column: str, decimals: int, unit: str) -> Column:
        return F.concat(plain_number(F.col(column), decimals), F.lit(unit)).alias(column)

    return cluster_profile(customers).select(
        "cluster_name",
        grouped_number(F.col("customers"), 0).alias("customers"),
        dollars(F.col("avg_spend")).alias("avg_spend"),
        shown("avg_frequency", 1, " orders"),
        shown("avg_recency", 0, " days ago"),
        dollars(F.col("avg_income"), 0).alias("avg_income"),
        shown("avg_age", 1, " years"),
        shown("avg_satisfaction", 2, " / 5.0"),
    )


def cluster_scatter(customers: DataFrame) -> DataFrame:
    """One point per purchasing customer, for the plots in two and three dimensions."""
    return customers.where(F.col("cluster_name") != "Never Purchased").select(
        "customer_id", "recency_days", "total_transactions", "total_spend", "avg_order_value", "cluster_name"
    )


def churn_by(customers: DataFrame, key: str) -> DataFrame:
    """Percentages of active and churned customers per group; both columns always exist."""
    known = F.count("churn_status").cast("double")

    def share(status: str) -> Column:
        return F.count_if(F.col("churn_status") == status).cast("double") / known * 100

    return (
        _present(customers, key, "churn_status")
        .groupBy(key)
        .agg(share("Active").alias("active_pct"), share("Churned").alias("churned_pct"))
    )


def churn_by_category(customers: DataFrame) -> DataFrame:
    return churn_by(customers, "preferred_category").orderBy("preferred_category")


def churn_by_location(customers: DataFrame) -> DataFrame:
    return churn_by(customers, "location").orderBy("churned_pct", "location")


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(key).limit(rows)
