"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shoplens_oracle import ORACLES  # noqa: E402
from shoplens.operators import clustering  # noqa: E402
from shoplens.operators.clustering import (  # noqa: E402
    SCALED,
    CLUSTER_NAMES,
    fit_clusters,
    kmeans_clusters,
    labelled,
    name_clusters,
    nearest_centre,
    scaled_features,
)
from shoplens.operators.distributions import (  # noqa: E402
    DASHBOARD_BINS,
    EXPLORATION_BINS,
    box_statistics,
    density_curve,
    histogram,
)
from shoplens.operators.order_stats import row_rank  # noqa: E402
from shoplens.operators.slicing import (  # noqa: E402
    DashboardFilter,
    filtered_customers,
    filtered_sales,
    filtered_transactions,
    sales,
)
from shoplens.plans import processing, quality, reports  # noqa: E402
from shoplens.plans.dashboard import purchasers_spend, spend_by_satisfaction  # noqa: E402
from shoplens.plans.segmentation import purchasers, rfm_scores  # noqa: E402
from shoplens.sources.readers import INPUT_ORDER, read_customers, read_transactions  # noqa: E402
from shoplens.sources.schemas import CUSTOMERS_RAW, TRANSACTIONS_RAW  # noqa: E402
from shoplens.sources.stages import StageStore  # noqa: E402
from shoplens.workspace import TYPICAL_CENTRES, Workspace  # noqa: E402

# One dashboard choice, for the queries that exercise the filters.
CHOICE = DashboardFilter(
    start=date(1996, 1, 1),
    end=date(2000, 12, 31),
    categories=["ECONOMY", "PROMO", "SMALL"],
    locations=[f"NATION_{i}" for i in range(10)],
)
EVERYTHING = DashboardFilter()

# Orders of this status are completed; the others leave some customers without a purchase.
COMPLETED = "F"

_WORKSPACES: dict[tuple[str, str, str | None], tuple[str, Workspace]] = {}


def workspace(spark: SparkSession, sf_dir: str, status: str | None = None) -> Workspace:
    """Stages are built once per application and folder, then shared by the queries.

    When a file of the folder's tables changes, they are built anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, status)
    inputs = Workspace.inputs(spark, sf_dir)
    if key not in _WORKSPACES or _WORKSPACES[key][0] != inputs:
        _WORKSPACES[key] = (inputs, Workspace(spark, sf_dir, status=status))
    return _WORKSPACES[key][1]


def _completed(query: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """The query over the lines of completed orders only."""
    return lambda w: query(workspace(w.spark, w.folder, COMPLETED))


def _money_as_double(df: DataFrame) -> DataFrame:
    decimals = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    return df.withColumns({name: F.col(name).cast("double") for name in decimals})


def _box_rounded(df: DataFrame) -> DataFrame:
    # Engines interpolate quartiles with a different last digit.
    return df.withColumns({c: F.round(c, 6) for c in ["q1", "median", "q3", "whisker_low", "whisker_high"]})


# Cleaning, features and profiles.


def customers_clean(w: Workspace) -> DataFrame:
    return w.customers_clean()


def transactions_dedup(w: Workspace) -> DataFrame:
    return _money_as_double(w.unique_transactions())


def transactions_enriched(w: Workspace) -> DataFrame:
    return _money_as_double(processing.enrich_transactions(w.unique_transactions()))


def customer_category_spend(w: Workspace) -> DataFrame:
    return _money_as_double(processing.category_spend(w.transactions()))


def preferred_category(w: Workspace) -> DataFrame:
    return processing.preferred_category(w.transactions())


def customer_profile(w: Workspace) -> DataFrame:
    return processing.customer_profiles(w.customers(), w.transactions())


def date_bounds(w: Workspace) -> DataFrame:
    return processing.date_bounds(w.transactions())


# Scores, segments and clusters.


def scored(w: Workspace) -> DataFrame:
    return rfm_scores(w.profiles(), w.store).select(
        "customer_id", "R_Score", "F_Score", "M_Score", "RFM_Score", "rfm_segment"
    )


def purchase_rank(w: Workspace) -> DataFrame:
    active = purchasers(w.profiles())
    frequency = row_rank(active, "total_transactions", "customer_id", "frequency_rank", w.store)
    return frequency.join(row_rank(active, "total_spend", "customer_id", "spend_rank", w.store), "customer_id")


def kmeans_features(w: Workspace) -> DataFrame:
    features = scaled_features(purchasers(w.profiles()))
    return features.select("customer_id", *[F.round(x, 6).alias(x) for x in SCALED])


def kmeans_assign_fixed(w: Workspace) -> DataFrame:
    features = scaled_features(purchasers(w.profiles()))
    return nearest_centre(features, TYPICAL_CENTRES).select(
        "customer_id", *[F.round(x, 6).alias(x) for x in SCALED], "kmeans_cluster"
    )


def cluster_medians(w: Workspace) -> DataFrame:
    features = scaled_features(purchasers(w.profiles()))
    return clustering.cluster_medians(nearest_centre(features, TYPICAL_CENTRES), w.store)


def kmeans_fitted(w: Workspace) -> DataFrame:
    features = scaled_features(purchasers(w.profiles()))
    return kmeans_clusters(features, w.store).select("customer_id", "kmeans_cluster")


def kmeans_invariants(w: Workspace) -> DataFrame:
    """What holds for any fit: all purchasers labelled at their nearest centre, four clusters named by spend."""
    features = scaled_features(purchasers(w.profiles()))
    model = fit_clusters(features, w.store)
    clustered = w.store.scratch("labelled", labelled(features, model).select("customer_id", "total_spend", *SCALED, "kmeans_cluster"))
    nearest = nearest_centre(clustered.withColumnRenamed("kmeans_cluster", "label"), model.centres)
    rows = nearest.agg(
        F.count("*").alias("purchasing_customers"),
        F.count_distinct("label").alias("clusters"),
        F.count_if(F.col("label") != F.col("kmeans_cluster")).alias("not_at_nearest_centre"),
    )
    names = F.array(*[F.lit(name) for name in CLUSTER_NAMES])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("median_spend")).alias("m"), "cluster_name"))), lambda x: x["cluster_name"])
    named = name_clusters(clustered, w.store).agg((in_order == names).alias("names_by_spend"))
    everyone = w.profiles().agg(F.count("*").alias("customers"))
    return rows.withColumns({"names_by_spend": named.scalar(), "customers": everyone.scalar()})


def segmented_scores(w: Workspace) -> DataFrame:
    """All that the fitted clusters don't decide."""
    return w.segmented().drop("kmeans_cluster", "cluster_name")


# Reports on everything, and on the filtered slice.


def _sales(w: Workspace, *keys: str) -> DataFrame:
    return sales(w.transactions(), keys)


def _everything(w: Workspace, attribute: str) -> DataFrame:
    return filtered_sales(w.transactions(), w.profiles(), EVERYTHING, attributes=(attribute,))


def _summed(report: Callable[[DataFrame], DataFrame], keys_of: str) -> Callable[[Workspace], DataFrame]:
    """A sales report of the filtered slice, from the sums that one scan gives all of them."""
    return lambda w: report(reports.of_report(w.sales_summary("chosen", CHOICE), keys_of))


def _chosen(w: Workspace) -> DataFrame:
    """The filtered customers with every attribute, labelled by fixed centres."""
    return filtered_customers(w.transactions(), w.segmented_by_centres(), CHOICE)


def duplicate_profile(w: Workspace) -> DataFrame:
    return quality.duplicate_profile(
        {"customers": (w.raw_customers(), "customer_id"), "transactions": (w.raw_transactions(), "transaction_id")}
    )


def _raw_preview(w: Workspace) -> DataFrame:
    columns = TRANSACTIONS_RAW.fieldNames()
    return _money_as_double(w.raw_transactions().select(columns).orderBy(*columns).limit(5))


def _chosen_histogram(column: str) -> Callable[[Workspace], DataFrame]:
    # Written first: the histogram reads its table twice.
    return lambda w: histogram(w.store.scratch("chosen", _chosen(w).select(column)), column, DASHBOARD_BINS)


def spend_by_satisfaction_box(w: Workspace) -> DataFrame:
    spend = purchasers_spend(w.unique_customers(), w.transactions(), w.store)
    return _box_rounded(box_statistics(spend, "satisfaction_score", "total_spend", w.store))


def dashboard_spend_by_satisfaction(w: Workspace) -> DataFrame:
    chosen = w.store.scratch("chosen", filtered_customers(w.transactions(), w.profiles(), CHOICE))
    return _box_rounded(spend_by_satisfaction(chosen, w.store))


# Stage tables.

# How each is built, and an amount and texts that are compared.
_STAGES = {
    "cleaned_transactions": (Workspace.transactions, "revenue", ["transaction_id", "product_name", "payment_method"]),
    "customer_profiles": (Workspace.profiles, "total_spend", ["gender", "location", "churn_status"]),
    "segmented_customers": (Workspace.segmented, "total_spend", ["location", "RFM_Score", "rfm_segment"]),
}


def stage_roundtrip(w: Workspace) -> DataFrame:
    """Shape of each stage table as read back, the sum of its amounts and the lengths of its texts."""
    parts = []
    for name, (build, amount, texts) in _STAGES.items():
        stage = w.store.read(name, build(w).schema)
        length = sum([F.coalesce(F.length(t), F.lit(0)) for t in texts], F.lit(0))
        parts.append(
            stage.agg(
                F.count("*").alias("row_count"),
                F.sum(F.col(amount).cast("decimal(28,8)")).cast("double").alias("amount"),
                F.sum(length).alias("text_length"),
            ).select(
                F.lit(name).alias("stage"), "row_count", F.lit(len(stage.columns)).alias("column_count"), "amount", "text_length"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def transactions_from_csv(w: Workspace) -> DataFrame:
    """Raw transactions written as CSV, read with the raw reader, without copies and enriched."""
    path = f"{w.store.root}/raw-csv/transactions.csv"
    raw = w.raw_transactions().select(TRANSACTIONS_RAW.fieldNames())
    writer = raw.write.mode("overwrite").options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    writer.csv(path)
    order = [c for c in TRANSACTIONS_RAW.fieldNames() if c != "transaction_id"]
    key = F.col("customer_id").cast(raw.schema["customer_id"].dataType)
    unique = processing.unique_transactions(read_transactions(w.spark, path).withColumn("customer_id", key), order)
    return _money_as_double(processing.enrich_transactions(unique))


def customers_from_csv(w: Workspace) -> DataFrame:
    """Raw customers written as CSV, with a line break and quotes in each location, and read by splits."""
    path = f"{w.store.root}/raw-csv/customers.csv"
    raw = w.raw_customers().select(CUSTOMERS_RAW.fieldNames())
    text = F.concat("location", F.lit('\n"'), "gender", F.lit('",'))
    raw.withColumn("location", text).write.mode("overwrite").options(header=True, escape='"').csv(path)
    key = F.col("customer_id").cast(raw.schema["customer_id"].dataType)
    return read_customers(w.spark, path, multi_line=True, store=w.store).withColumn("customer_id", key).drop(*INPUT_ORDER)


def stage_roundtrip_csv(w: Workspace) -> DataFrame:
    """Profiles written as CSV and read back with the fixed schema."""
    csv = StageStore(w.spark, w.store.root + "/csv", fmt="csv")
    return csv.table("customer_profiles", w.profiles)


_QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {
    "customers_clean": customers_clean,
    "transactions_dedup": transactions_dedup,
    "transactions_enriched": transactions_enriched,
    "customer_category_spend": customer_category_spend,
    "preferred_category": preferred_category,
    "customer_profile": customer_profile,
    "date_bounds": date_bounds,
    "rfm_scores": scored,
    "purchase_rank": purchase_rank,
    "kmeans_features": kmeans_features,
    "kmeans_assign_fixed": kmeans_assign_fixed,
    "cluster_medians": cluster_medians,
    "kmeans_clusters": kmeans_fitted,
    "kmeans_invariants": kmeans_invariants,
    "segmented_customers": Workspace.segmented,
    "segmented_scores": segmented_scores,
    "segmented_customers_fixed": Workspace.segmented_by_centres,
    # Lines of completed orders only, which leave some customers without a purchase.
    "customer_profile_completed": _completed(customer_profile),
    "segmented_customers_fixed_completed": _completed(Workspace.segmented_by_centres),
    "transactions_from_csv": transactions_from_csv,
    "customers_from_csv": customers_from_csv,
    # Whole tables.
    "monthly_revenue": lambda w: reports.monthly_revenue(_sales(w, "year_month")),
    "revenue_by_season": lambda w: reports.revenue_by_season(_sales(w, "season")),
    "payment_split": lambda w: reports.payment_split(_sales(w, "payment_method")),
    "revenue_by_location": lambda w: reports.revenue_by_location(_everything(w, "location")),
    "category_performance": lambda w: reports.category_performance(_sales(w, "product_category")),
    "category_table_formatted": lambda w: reports.category_table(_sales(w, "product_category")),
    "top_products": lambda w: reports.top_products(_sales(w, "product_category", "product_name")),
    "kpi_cards": lambda w: reports.kpi_cards(_everything(w, "churn_status")),
    "filter_options": lambda w: reports.filter_options(w.transactions(), w.customers()),
    "rfm_distribution": lambda w: reports.rfm_distribution(w.segmented_by_centres()),
    "rfm_segment_metrics": lambda w: reports.rfm_segment_metrics(w.segmented_by_centres()),
    "cluster_distribution": lambda w: reports.cluster_distribution(w.segmented_by_centres()),
    "cluster_profile": lambda w: reports.cluster_profile(w.segmented_by_centres()),
    "cluster_profile_formatted": lambda w: reports.cluster_profile_formatted(w.segmented_by_centres()),
    "cluster_scatter": lambda w: reports.cluster_scatter(w.segmented_by_centres()),
    "satisfaction_distribution": lambda w: reports.satisfaction_distribution(w.unique_customers()),
    "churn_by_category": lambda w: reports.churn_by_category(w.profiles()),
    "churn_by_location": lambda w: reports.churn_by_location(w.profiles()),
    "location_distribution": lambda w: reports.location_distribution(w.unique_customers()),
    "gender_distribution": lambda w: reports.gender_distribution(w.unique_customers()),
    "null_profile": lambda w: quality.null_profile(w.column_counts()),
    "duplicate_profile": duplicate_profile,
    "table_profile": lambda w: quality.table_profile(w.column_counts()),
    "preview_customers": lambda w: reports.preview(w.raw_customers(), "customer_id"),
    "preview_raw_transactions": _raw_preview,
    "preview_transactions": lambda w: _money_as_double(reports.preview(w.transactions(), "transaction_id")),
    "preview_segmented": lambda w: reports.preview(w.segmented_by_centres(), "customer_id"),
    "age_histogram": lambda w: histogram(w.unique_customers(), "age", EXPLORATION_BINS),
    "income_histogram": lambda w: histogram(w.unique_customers(), "annual_income", EXPLORATION_BINS),
    "age_kde": lambda w: density_curve(w.unique_customers(), "age", EXPLORATION_BINS),
    "income_kde": lambda w: density_curve(w.unique_customers(), "annual_income", EXPLORATION_BINS),
    "spend_by_satisfaction_box": spend_by_satisfaction_box,
    # The dashboard after a choice of filters.
    "filtered_transactions": lambda w: _money_as_double(
        filtered_transactions(w.transactions(), w.profiles(), CHOICE)
    ),
    "filtered_customers": lambda w: filtered_customers(w.transactions(), w.profiles(), CHOICE),
    "dashboard_kpi_cards": _summed(reports.kpi_cards, "kpi_cards"),
    "dashboard_kpi_cards_formatted": _summed(reports.kpi_cards_formatted, "kpi_cards"),
    "dashboard_monthly_revenue": _summed(reports.monthly_revenue, "monthly_revenue"),
    "dashboard_payment_split": _summed(reports.payment_split, "payment_split"),
    "dashboard_revenue_by_location": _summed(reports.revenue_by_location, "revenue_by_location"),
    "dashboard_category_performance": _summed(reports.category_performance, "category_performance"),
    "dashboard_category_table_formatted": _summed(reports.category_table, "category_performance"),
    "dashboard_top_products": _summed(reports.top_products, "top_products"),
    "dashboard_rfm_distribution": lambda w: reports.rfm_distribution(_chosen(w)),
    "dashboard_cluster_profile": lambda w: reports.cluster_profile(_chosen(w)),
    "dashboard_cluster_profile_formatted": lambda w: reports.cluster_profile_formatted(_chosen(w)),
    "dashboard_cluster_scatter": lambda w: reports.cluster_scatter(_chosen(w)),
    "dashboard_satisfaction": lambda w: reports.satisfaction_distribution(_chosen(w)),
    "dashboard_churn_by_category": lambda w: reports.churn_by_category(_chosen(w)),
    "dashboard_churn_by_location": lambda w: reports.churn_by_location(_chosen(w)),
    "dashboard_age_histogram": _chosen_histogram("age"),
    "dashboard_income_histogram": _chosen_histogram("annual_income"),
    "dashboard_spend_by_satisfaction": dashboard_spend_by_satisfaction,
    # Stages.
    "stage_roundtrip": stage_roundtrip,
    "stage_roundtrip_csv": stage_roundtrip_csv,
}


def _corpus() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the corpus operators; none where that subpackage is not installed."""
    try:
        from shoplens.llm.registry import QUERIES, SQL
    except ModuleNotFoundError as error:
        if error.name not in ("shoplens.llm", "shoplens.llm.registry", "corpus_pipeline"):
            raise
        return {}, {}
    return QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator or report: ``(spark, sf_dir) -> DataFrame``."""

    def bound(query: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(workspace(spark, sf_dir))

    return {name: bound(query) for name, query in _QUERIES.items()} | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the same tables; none where K-Means decides the result."""
    return ORACLES | _corpus()[1]


def entry(spark: SparkSession) -> DataFrame:
    """Customers per recency-frequency-monetary segment."""
    return queries()["rfm_distribution"](spark, "/root/testdata/sf0.001")
