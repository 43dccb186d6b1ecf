"""Row-level column expressions; every one stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shoplens.sources.schemas import MONEY

# Fixed values of the customer model.
NEVER_PURCHASED_RECENCY = 365 * 3
CHURN_AFTER_DAYS = 180
DEFAULT_SATISFACTION = 3
NO_CATEGORY = "None"


def net_revenue(price: Column, quantity: Column, discount: Column) -> Column:
    """Price times quantity less the discount, exact; null if any part is."""
    return (price * quantity * (F.lit(1) - discount)).cast(MONEY)


def money_sum(amount: Column) -> Column:
    """Exact sum of a money column; 0 when there is nothing to add up."""
    return F.coalesce(F.sum(amount), F.lit(0).cast("decimal(28,8)"))


def season(month: Column) -> Column:
    # A missing month belongs to no listed season, so it lands in the rest like months 9 to 11.
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def calendar_columns(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "day_of_week": F.date_format(ts, "EEEE"),
        "year_month": F.date_format(ts, "yyyy-MM"),
        "season": season(F.month(ts)),
    }


def whole_days(earlier: Column, later: Column) -> Column:
    """Completed 24-hour days between two zone-less timestamps (not the midnights crossed)."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def churn_status(recency_days: Column) -> Column:
    return F.when(recency_days > CHURN_AFTER_DAYS, "Churned").otherwise("Active")


def rfm_code(r: Column, f: Column, m: Column) -> Column:
    return F.concat(r.cast("string"), f.cast("string"), m.cast("string"))


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment name of three 1-5 scores; the first rule that holds decides.

    Names and thresholds are fixed values.
    """
    # F and M enter every rule through the weaker of the two.
    weaker = F.least(f, m)
    return (
        F.when((r >= 4) & (weaker >= 4), "Champions")
        .when((r >= 3) & (weaker >= 3), "Loyalists")
        .when((r >= 4) & (weaker >= 2), "Potential Loyalists")
        .when((r >= 4) & (weaker == 1), "New Customers")
        .when((r <= 2) & (weaker >= 4), "Can't Lose Them")
        .when((r <= 2) & (weaker >= 2), "At Risk")
        .otherwise("Hibernating")
    )


def grouped_number(x: Column, decimals: int) -> Column:
    """``1,234.50``: thousands separators, halves rounded to even."""
    return F.format_number(x, decimals)


def plain_number(x: Column, decimals: int) -> Column:
    """``1234.50``: as :func:`grouped_number` without the separators."""
    return F.replace(F.format_number(x, decimals), F.lit(","), F.lit(""))


def dollars(x: Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("$"), grouped_number(x, decimals))
