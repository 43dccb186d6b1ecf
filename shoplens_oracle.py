"""DuckDB SQL giving the result of each registered query from the same tables."""

from __future__ import annotations

_CLEAN = """
WITH customers_raw AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_custkey % 19 <> 0 THEN CAST(18 + c_custkey % 63 AS DOUBLE) END AS age,
         c_mktsegment AS gender,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS annual_income,
         n_name AS location,
         DATE '1995-01-01' + CAST(c_custkey * 37 % 2500 AS INTEGER) AS join_date,
         CASE WHEN c_custkey % 17 <> 0 THEN CAST(1 + c_custkey % 5 AS DOUBLE) END AS satisfaction_score
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
customers_unique AS (
  SELECT * FROM customers_raw QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY join_date) = 1),
medians AS (
  SELECT quantile_cont(age, 0.5) AS mid_age, quantile_cont(annual_income, 0.5) AS mid_income FROM customers_unique),
customers AS (
  SELECT customer_id,
         CAST(trunc(coalesce(age, mid_age)) AS INTEGER) AS age,
         gender,
         CAST(trunc(coalesce(annual_income, mid_income)) AS INTEGER) AS annual_income,
         location, join_date,
         CAST(trunc(coalesce(satisfaction_score, 3)) AS INTEGER) AS satisfaction_score
  FROM customers_unique, medians),
lines AS (
  SELECT l_orderkey || '-' || l_linenumber AS transaction_id, o_custkey AS customer_id,
         CAST(o_orderdate AS TIMESTAMP) AS transaction_date, p_type AS product_category, p_name AS product_name,
         CAST(trunc(l_quantity) AS INTEGER) AS quantity, CAST(p_retailprice AS DECIMAL(14,4)) AS price,
         CAST(l_discount AS DECIMAL(5,4)) AS discount_applied, o_orderpriority AS payment_method,
         l_shipdate, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
tx_unique AS (
  SELECT * EXCLUDE (l_shipdate, l_partkey, l_suppkey) FROM lines
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY l_shipdate, l_partkey, l_suppkey) = 1),
tx AS (
  SELECT *, CAST(price * quantity * (1 - discount_applied) AS DECIMAL(18,8)) AS revenue,
         CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
         CAST(quarter(transaction_date) AS INTEGER) AS quarter, dayname(transaction_date) AS day_of_week,
         strftime(transaction_date, '%Y-%m') AS year_month,
         CASE WHEN month(transaction_date) IN (12, 1, 2) THEN 'Winter'
              WHEN month(transaction_date) IN (3, 4, 5) THEN 'Spring'
              WHEN month(transaction_date) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season
  FROM tx_unique)
"""

_PROFILE = (
    _CLEAN
    + """,
category_spend AS (
  SELECT customer_id, product_category, sum(revenue) AS spend FROM tx GROUP BY ALL),
favourite AS (
  SELECT customer_id, product_category AS preferred_category FROM category_spend
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY spend DESC, product_category) = 1),
metrics AS (
  SELECT customer_id, CAST(sum(revenue) AS DOUBLE) AS total_spend, count(transaction_id) AS total_transactions,
         CAST(sum(quantity) AS BIGINT) AS total_items_purchased,
         CAST(sum(discount_applied) AS DOUBLE) / count(discount_applied) AS avg_discount_received,
         max(transaction_date) AS last_purchase_date, min(transaction_date) AS first_purchase_date
  FROM tx GROUP BY customer_id),
newest AS (SELECT max(transaction_date) AS newest FROM tx),
joined AS (
  SELECT c.*, coalesce(total_spend, 0) AS total_spend, coalesce(total_transactions, 0) AS total_transactions,
         coalesce(total_items_purchased, 0) AS total_items_purchased,
         coalesce(avg_discount_received, 0) AS avg_discount_received,
         last_purchase_date, first_purchase_date,
         coalesce(total_spend / total_transactions, 0) AS avg_order_value,
         coalesce(preferred_category, 'None') AS preferred_category,
         coalesce(date_sub('day', last_purchase_date, newest), 1095) AS recency_days,
         greatest(date_sub('day', CAST(join_date AS TIMESTAMP), newest), 1) AS tenure_days
  FROM customers c LEFT JOIN metrics USING (customer_id) LEFT JOIN favourite USING (customer_id), newest),
profile AS (
  SELECT *, total_transactions / tenure_days * 100 AS purchase_frequency_normalized,
         CASE WHEN recency_days > 180 THEN 'Churned' ELSE 'Active' END AS churn_status
  FROM joined)
"""
)

_SEGMENT = (
    _PROFILE
    + """,
active AS (
  SELECT *, row_number() OVER (ORDER BY total_transactions, customer_id) AS frequency_rank,
         row_number() OVER (ORDER BY total_spend, customer_id) AS spend_rank, count(*) OVER () AS n
  FROM profile WHERE total_transactions > 0),
edges AS (SELECT quantile_cont(recency_days, [0.2, 0.4, 0.6, 0.8]) AS e FROM active),
scores AS (
  SELECT active.*, CAST(5 - (recency_days > e[1])::INT - (recency_days > e[2])::INT
                   - (recency_days > e[3])::INT - (recency_days > e[4])::INT AS INTEGER) AS R_Score,
         CAST(greatest(1, ((frequency_rank - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS F_Score,
         CAST(greatest(1, ((spend_rank - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS M_Score
  FROM active, edges),
rfm AS (
  SELECT *, R_Score || '' || F_Score || M_Score AS RFM_Score,
         CASE WHEN R_Score >= 4 AND F_Score >= 4 AND M_Score >= 4 THEN 'Champions'
              WHEN R_Score >= 3 AND F_Score >= 3 AND M_Score >= 3 THEN 'Loyalists'
              WHEN R_Score >= 4 AND F_Score >= 2 AND M_Score >= 2 THEN 'Potential Loyalists'
              WHEN R_Score >= 4 AND (F_Score = 1 OR M_Score = 1) THEN 'New Customers'
              WHEN R_Score <= 2 AND F_Score >= 4 AND M_Score >= 4 THEN 'Can''t Lose Them'
              WHEN R_Score <= 2 AND F_Score >= 2 AND M_Score >= 2 THEN 'At Risk'
              ELSE 'Hibernating' END AS rfm_segment
  FROM scores),
logs AS (
  SELECT *, ln(1.001 + recency_days) AS lr, ln(1.001 + total_transactions) AS lf, ln(1.001 + total_spend) AS lm
  FROM rfm),
moments AS (
  SELECT avg(lr) AS ar, stddev_pop(lr) AS sr, avg(lf) AS af, stddev_pop(lf) AS sf, avg(lm) AS am, stddev_pop(lm) AS sm
  FROM logs),
features AS (
  SELECT logs.*, (lr - ar) / sr AS recency_days_scaled, (lf - af) / sf AS total_transactions_scaled,
         (lm - am) / sm AS total_spend_scaled
  FROM logs, moments),
centres(i, x, y, z) AS (VALUES {centres}),
clustered AS (
  SELECT f.*, CAST(i AS INTEGER) AS kmeans_cluster FROM features f, centres
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY
    pow(recency_days_scaled - x, 2) + pow(total_transactions_scaled - y, 2) + pow(total_spend_scaled - z, 2), i) = 1),
named AS (
  SELECT kmeans_cluster, ['VIP Spenders', 'Active Customers', 'Slipping Customers', 'Lost Customers'][
         row_number() OVER (ORDER BY median(total_spend) DESC, kmeans_cluster)] AS cluster_name
  FROM clustered GROUP BY kmeans_cluster),
segmented AS (
  SELECT {profile_columns}, R_Score, F_Score, M_Score, RFM_Score, rfm_segment, kmeans_cluster, cluster_name
  FROM clustered JOIN named USING (kmeans_cluster)
  UNION ALL
  SELECT {profile_columns}, 0, 0, 0, '000', 'Inactive', -1, 'Never Purchased'
  FROM profile WHERE total_transactions = 0)
"""
)

_CLEAN_COLUMNS = "customer_id, age, gender, annual_income, location, join_date, satisfaction_score"
_PROFILE_COLUMNS = (
    _CLEAN_COLUMNS
    + ", total_spend, total_transactions, total_items_purchased, avg_discount_received, last_purchase_date,"
    " first_purchase_date, avg_order_value, preferred_category, recency_days, tenure_days,"
    " purchase_frequency_normalized, churn_status"
)
_CENTRES = "(0, -0.8, 0.9, 0.9), (1, 0.5, 0.4, 0.4), (2, -0.3, -0.7, -0.7), (3, 1.0, -2.0, -2.2)"
_SEGMENT = _SEGMENT.format(centres=_CENTRES, profile_columns=_PROFILE_COLUMNS)

_CHOSEN = """,
slice AS (
  SELECT * FROM tx
  WHERE transaction_date >= TIMESTAMP '1996-01-01' AND transaction_date < TIMESTAMP '2001-01-01'
    AND product_category IN ('ECONOMY', 'PROMO', 'SMALL')),
chosen_ids AS (
  SELECT customer_id FROM customers
  WHERE location IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6', 'NATION_7',
                     'NATION_8', 'NATION_9')
    AND customer_id IN (SELECT customer_id FROM slice)),
chosen_tx AS (SELECT * FROM slice WHERE customer_id IN (SELECT customer_id FROM chosen_ids))
"""
_CHOSEN_SEGMENTED = _CHOSEN + """,
chosen AS (SELECT * FROM segmented WHERE customer_id IN (SELECT customer_id FROM chosen_ids))
"""

_TX_COLUMNS = (
    "transaction_id, customer_id, transaction_date, product_category, product_name, quantity,"
    " CAST(price AS DOUBLE) AS price, CAST(discount_applied AS DOUBLE) AS discount_applied, payment_method"
)
_TX_FEATURES = "CAST(revenue AS DOUBLE) AS revenue, year, month, quarter, day_of_week, year_month, season"


def _revenue_by(keys: str, source: str) -> str:
    return f"SELECT {keys}, CAST(sum(revenue) AS DOUBLE) AS revenue FROM {source} GROUP BY {keys}"


def _payment(source: str) -> str:
    return f"""
SELECT payment_method, CAST(s AS DOUBLE) AS revenue, CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) * 100 AS share_pct
FROM (SELECT payment_method, sum(revenue) AS s FROM {source} GROUP BY payment_method)"""


def _by_location(source: str) -> str:
    return f"""
SELECT location, CAST(sum(revenue) AS DOUBLE) AS revenue FROM {source} JOIN customers USING (customer_id)
GROUP BY location"""


def _category(source: str) -> str:
    return f"""
SELECT product_category, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(count(transaction_id) AS BIGINT) AS orders
FROM {source} GROUP BY product_category"""


def _top(source: str) -> str:
    return _revenue_by("product_category, product_name", source) + (
        " ORDER BY revenue DESC, product_category, product_name LIMIT 10"
    )


def _kpis(tx: str, customers: str) -> str:
    return f"""
SELECT total_revenue, active_customers, total_orders, churned_customers,
       coalesce(total_revenue / nullif(total_orders, 0), 0) AS avg_order_value,
       coalesce(churned_customers / nullif(active_customers, 0), 0) * 100 AS churn_rate,
       coalesce(churned_customers / nullif(active_customers, 0), 0) * 100 > 20 AS churn_alert
FROM (SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS total_revenue, count(*) AS total_orders FROM {tx}),
     (SELECT count(DISTINCT customer_id) AS active_customers,
             count(*) FILTER (churn_status = 'Churned') AS churned_customers FROM {customers})"""


def _count(key: str, source: str) -> str:
    return f"SELECT {key}, count(*) AS customers FROM {source} GROUP BY {key}"


def _churn(key: str, source: str) -> str:
    return f"""
SELECT {key}, count(*) FILTER (churn_status = 'Active') / count(*) * 100 AS active_pct,
       count(*) FILTER (churn_status = 'Churned') / count(*) * 100 AS churned_pct
FROM {source} GROUP BY {key}"""


def _cluster_profile(source: str) -> str:
    return f"""
SELECT cluster_name, count(*) AS customers,
       CAST(sum(CAST(total_spend AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_spend,
       CAST(sum(total_transactions) AS DOUBLE) / count(*) AS avg_frequency,
       CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency,
       CAST(sum(annual_income) AS DOUBLE) / count(*) AS avg_income,
       CAST(sum(age) AS DOUBLE) / count(*) AS avg_age,
       CAST(sum(satisfaction_score) AS DOUBLE) / count(*) AS avg_satisfaction
FROM {source} GROUP BY cluster_name"""


def _histogram(column: str, source: str, bins: int) -> str:
    return f""",
numbers AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
bounds AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins} AS w FROM numbers),
guessed AS (SELECT x, lo, w, least(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INTEGER), {bins - 1}) AS g
            FROM numbers, bounds),
placed AS (SELECT CASE WHEN x < g * w + lo THEN g - 1 WHEN x >= (g + 1) * w + lo AND g < {bins - 1} THEN g + 1
                       ELSE g END AS bin FROM guessed)
SELECT CAST(i AS INTEGER) AS bin, i * w + lo AS bin_start,
       CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * w + lo END AS bin_end,
       (SELECT count(*) FROM placed WHERE bin = i) AS customers
FROM range({bins}) t(i), bounds"""


def _density(column: str, source: str, bins: int) -> str:
    return f""",
numbers AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
summary AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h FROM numbers),
counted AS (SELECT x, count(*) AS times FROM numbers GROUP BY x),
curve AS (
  SELECT i, any_value(i * ((hi - lo) / 199) + lo) AS place,
         sum(times * exp(-0.5 * pow((i * ((hi - lo) / 199) + lo - x) / h, 2))) / any_value(n * h * sqrt(2 * pi())) AS d,
         any_value(n * ((hi - lo) / {bins})) AS unit
  FROM counted, summary, range(200) t(i) GROUP BY i)
SELECT CAST(i AS INTEGER) AS point, round(place, 6) AS x, round(d, 6) AS density, round(d * unit, 6) AS scaled FROM curve"""


def _box(source: str) -> str:
    return f""",
spend AS ({source}),
boxes AS (SELECT satisfaction_score, quantile_cont(total_spend, [0.25, 0.5, 0.75]) AS q FROM spend GROUP BY 1),
reached AS (
  SELECT spend.*, q, total_spend BETWEEN q[1] - 1.5 * (q[3] - q[1]) AND q[3] + 1.5 * (q[3] - q[1]) AS inside
  FROM spend JOIN boxes USING (satisfaction_score))
SELECT satisfaction_score, count(*) AS customers, min(total_spend) AS lowest,
       round(least(min(total_spend) FILTER (inside), any_value(q[1])), 6) AS whisker_low,
       round(any_value(q[1]), 6) AS q1, round(any_value(q[2]), 6) AS median, round(any_value(q[3]), 6) AS q3,
       round(greatest(max(total_spend) FILTER (inside), any_value(q[3])), 6) AS whisker_high,
       max(total_spend) AS highest, count(*) FILTER (NOT inside) AS outliers
FROM reached GROUP BY satisfaction_score"""


_RAW_CUSTOMERS = {
    "customer_id": "bigint",
    "age": "double",
    "gender": "string",
    "annual_income": "double",
    "location": "string",
    "join_date": "date",
    "satisfaction_score": "double",
}
_RAW_TRANSACTIONS = {
    "transaction_id": "string",
    "customer_id": "bigint",
    "transaction_date": "timestamp_ntz",
    "product_category": "string",
    "product_name": "string",
    "quantity": "int",
    "price": "decimal(14,4)",
    "discount_applied": "decimal(5,4)",
    "payment_method": "string",
}
_RAW = [("customers", "customers_raw", _RAW_CUSTOMERS), ("transactions", "lines", _RAW_TRANSACTIONS)]


def _null_profile() -> str:
    return " UNION ALL ".join(
        f" SELECT '{table}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {source}"
        for table, source, columns in _RAW
        for c in columns
    )


def _table_profile() -> str:
    return " UNION ALL ".join(
        f" SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type, count({c}) AS non_null_count,"
        f" count(*) AS row_count, {len(columns)} AS column_count FROM {source}"
        for table, source, columns in _RAW
        for c, kind in columns.items()
    )


def _completed(sql: str) -> str:
    """The same over the lines of completed orders only."""
    joined = "JOIN part ON l_partkey = p_partkey"
    return sql.replace(joined, f"{joined} WHERE o_orderstatus = 'F'", 1)


def _category_shown(source: str) -> str:
    return f"""
SELECT product_category, '$' || format('{{:,.2f}}', revenue) AS revenue, format('{{:,}}', orders) AS orders
FROM ({_category(source)})"""


def _cluster_shown(source: str) -> str:
    return f"""
SELECT cluster_name, format('{{:,}}', customers) AS customers,
       '$' || format('{{:,.2f}}', avg_spend) AS avg_spend, format('{{:.1f}} orders', avg_frequency) AS avg_frequency,
       format('{{:.0f}} days ago', avg_recency) AS avg_recency, '$' || format('{{:,.0f}}', avg_income) AS avg_income,
       format('{{:.1f}} years', avg_age) AS avg_age, format('{{:.2f}} / 5.0', avg_satisfaction) AS avg_satisfaction
FROM ({_cluster_profile(source)})"""


def _scatter(source: str) -> str:
    return f"""
SELECT customer_id, recency_days, total_transactions, total_spend, avg_order_value, cluster_name
FROM {source} WHERE cluster_name <> 'Never Purchased'"""


ORACLES: dict[str, str] = {
    "customers_clean": _CLEAN + "SELECT * FROM customers",
    "transactions_dedup": _CLEAN + f"SELECT {_TX_COLUMNS} FROM tx_unique",
    "transactions_enriched": _CLEAN + f"SELECT {_TX_COLUMNS}, {_TX_FEATURES} FROM tx",
    "customer_category_spend": _PROFILE
    + "SELECT customer_id, product_category, CAST(spend AS DOUBLE) AS spend FROM category_spend",
    "preferred_category": _PROFILE + "SELECT * FROM favourite",
    "customer_profile": _PROFILE + "SELECT * FROM profile",
    "date_bounds": _CLEAN + "SELECT min(transaction_date) AS min_date, max(transaction_date) AS max_date FROM tx",
    "rfm_scores": _SEGMENT + "SELECT customer_id, R_Score, F_Score, M_Score, RFM_Score, rfm_segment FROM rfm",
    "purchase_rank": _SEGMENT + "SELECT customer_id, frequency_rank, spend_rank FROM active",
    "kmeans_features": _SEGMENT
    + """SELECT customer_id, round(recency_days_scaled, 6) AS recency_days_scaled,
       round(total_transactions_scaled, 6) AS total_transactions_scaled,
       round(total_spend_scaled, 6) AS total_spend_scaled FROM features""",
    "kmeans_assign_fixed": _SEGMENT
    + """SELECT customer_id, round(recency_days_scaled, 6) AS recency_days_scaled,
       round(total_transactions_scaled, 6) AS total_transactions_scaled,
       round(total_spend_scaled, 6) AS total_spend_scaled, kmeans_cluster FROM clustered""",
    "cluster_medians": _SEGMENT
    + """SELECT kmeans_cluster, median(recency_days) AS median_recency, median(total_transactions) AS median_frequency,
       median(total_spend) AS median_spend, CAST(row_number() OVER (ORDER BY median(total_spend) DESC, kmeans_cluster) AS INTEGER) AS spend_rank,
       any_value(cluster_name) AS cluster_name
FROM clustered JOIN named USING (kmeans_cluster) GROUP BY kmeans_cluster""",
    "segmented_customers_fixed": _SEGMENT + "SELECT * FROM segmented",
    "segmented_scores": _SEGMENT + "SELECT * EXCLUDE (kmeans_cluster, cluster_name) FROM segmented",
    "kmeans_invariants": _PROFILE
    + """SELECT count(*) FILTER (total_transactions > 0) AS purchasing_customers, CAST(4 AS BIGINT) AS clusters,
       CAST(0 AS BIGINT) AS not_at_nearest_centre, true AS names_by_spend, count(*) AS customers FROM profile""",
    "customer_profile_completed": _completed(_PROFILE + "SELECT * FROM profile"),
    "segmented_customers_fixed_completed": _completed(_SEGMENT + "SELECT * FROM segmented"),
    "transactions_from_csv": _CLEAN.replace(
        "ORDER BY l_shipdate, l_partkey, l_suppkey",
        "ORDER BY customer_id, transaction_date, product_category, product_name, quantity, price, discount_applied, payment_method",
    )
    + f"SELECT {_TX_COLUMNS}, {_TX_FEATURES} FROM tx",
    "customers_from_csv": _CLEAN
    + """SELECT * REPLACE (location || chr(10) || '"' || gender || '",' AS location) FROM customers_raw""",
    "monthly_revenue": _CLEAN + _revenue_by("year_month", "tx"),
    "revenue_by_season": _CLEAN + _revenue_by("season", "tx"),
    "payment_split": _CLEAN + _payment("tx"),
    "revenue_by_location": _CLEAN + _by_location("tx"),
    "category_performance": _CLEAN + _category("tx"),
    "category_table_formatted": _CLEAN + _category_shown("tx"),
    "top_products": _CLEAN + _top("tx"),
    "kpi_cards": _PROFILE
    + _kpis(
        "tx WHERE customer_id IN (SELECT customer_id FROM customers)",
        "profile WHERE customer_id IN (SELECT customer_id FROM tx)",
    ),
    "filter_options": _CLEAN
    + """SELECT DISTINCT 'category' AS kind, product_category AS value FROM tx
UNION ALL SELECT DISTINCT 'location', location FROM customers""",
    "rfm_distribution": _SEGMENT + _count("rfm_segment", "segmented"),
    "rfm_segment_metrics": _SEGMENT
    + """SELECT rfm_segment, CAST(sum(CAST(total_spend AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_spend,
       CAST(sum(recency_days) AS DOUBLE) / count(*) AS avg_recency, count(*) AS customers
FROM segmented GROUP BY rfm_segment""",
    "cluster_distribution": _SEGMENT + _count("cluster_name", "segmented"),
    "cluster_profile": _SEGMENT + _cluster_profile("segmented"),
    "cluster_profile_formatted": _SEGMENT + _cluster_shown("segmented"),
    "cluster_scatter": _SEGMENT + _scatter("segmented"),
    "satisfaction_distribution": _CLEAN + _count("satisfaction_score", "customers_unique WHERE satisfaction_score IS NOT NULL"),
    "churn_by_category": _PROFILE + _churn("preferred_category", "profile"),
    "churn_by_location": _PROFILE + _churn("location", "profile"),
    "location_distribution": _CLEAN + _count("location", "customers_unique"),
    "gender_distribution": _CLEAN
    + """SELECT gender, customers, share_pct, format('{:.1f}%', share_pct) AS share_label
FROM (SELECT gender, count(*) AS customers, count(*) / sum(count(*)) OVER () * 100 AS share_pct
      FROM customers_unique GROUP BY gender)""",
    "null_profile": _CLEAN + _null_profile(),
    "duplicate_profile": _CLEAN
    + """SELECT 'customers' AS table_name, 'customer_id' AS key_column, count(*) AS row_count,
       count(*) - count(DISTINCT customer_id) AS duplicate_rows FROM customers_raw
UNION ALL SELECT 'transactions', 'transaction_id', count(*), count(*) - count(DISTINCT transaction_id) FROM lines""",
    "table_profile": _CLEAN + _table_profile(),
    "preview_customers": _CLEAN + "SELECT * FROM customers_raw ORDER BY customer_id LIMIT 5",
    "preview_raw_transactions": _CLEAN
    + f"""SELECT {_TX_COLUMNS} FROM lines ORDER BY transaction_id, customer_id, transaction_date, product_category,
       product_name, quantity, price, discount_applied, payment_method LIMIT 5""",
    "preview_transactions": _CLEAN + f"SELECT {_TX_COLUMNS}, {_TX_FEATURES} FROM tx ORDER BY transaction_id LIMIT 5",
    "preview_segmented": _SEGMENT + "SELECT * FROM segmented ORDER BY customer_id LIMIT 5",
    "age_histogram": _CLEAN + _histogram("age", "customers_unique", 20),
    "income_histogram": _CLEAN + _histogram("annual_income", "customers_unique", 20),
    "age_kde": _CLEAN + _density("age", "customers_unique", 20),
    "income_kde": _CLEAN + _density("annual_income", "customers_unique", 20),
    "spend_by_satisfaction_box": _PROFILE
    + _box("""SELECT satisfaction_score, total_spend FROM metrics JOIN customers_unique USING (customer_id)
  WHERE satisfaction_score IS NOT NULL"""),
    "filtered_transactions": _CLEAN + _CHOSEN + f"SELECT {_TX_COLUMNS}, {_TX_FEATURES} FROM chosen_tx",
    "filtered_customers": _PROFILE
    + _CHOSEN
    + "SELECT * FROM profile WHERE customer_id IN (SELECT customer_id FROM chosen_ids)",
    "dashboard_kpi_cards": _PROFILE
    + _CHOSEN
    + _kpis("chosen_tx", "profile WHERE customer_id IN (SELECT customer_id FROM chosen_ids)"),
    "dashboard_kpi_cards_formatted": _PROFILE
    + _CHOSEN
    + f"""SELECT '$' || format('{{:,.2f}}', total_revenue) AS total_revenue,
       format('{{:,}}', active_customers) AS active_customers, format('${{:.2f}}', avg_order_value) AS avg_order_value,
       format('{{:.1f}}%', churn_rate) AS churn_rate, churned_customers || ' customers at risk' AS churn_note, churn_alert
FROM ({_kpis("chosen_tx", "profile WHERE customer_id IN (SELECT customer_id FROM chosen_ids)")})""",
    "dashboard_monthly_revenue": _CLEAN + _CHOSEN + _revenue_by("year_month", "chosen_tx"),
    "dashboard_payment_split": _CLEAN + _CHOSEN + _payment("chosen_tx"),
    "dashboard_revenue_by_location": _CLEAN + _CHOSEN + _by_location("chosen_tx"),
    "dashboard_category_performance": _CLEAN + _CHOSEN + _category("chosen_tx"),
    "dashboard_category_table_formatted": _CLEAN + _CHOSEN + _category_shown("chosen_tx"),
    "dashboard_top_products": _CLEAN + _CHOSEN + _top("chosen_tx"),
    "dashboard_rfm_distribution": _SEGMENT + _CHOSEN_SEGMENTED + _count("rfm_segment", "chosen"),
    "dashboard_cluster_profile": _SEGMENT + _CHOSEN_SEGMENTED + _cluster_profile("chosen"),
    "dashboard_cluster_profile_formatted": _SEGMENT + _CHOSEN_SEGMENTED + _cluster_shown("chosen"),
    "dashboard_cluster_scatter": _SEGMENT + _CHOSEN_SEGMENTED + _scatter("chosen"),
    "dashboard_satisfaction": _SEGMENT + _CHOSEN_SEGMENTED + _count("satisfaction_score", "chosen"),
    "dashboard_churn_by_category": _SEGMENT + _CHOSEN_SEGMENTED + _churn("preferred_category", "chosen"),
    "dashboard_churn_by_location": _SEGMENT + _CHOSEN_SEGMENTED + _churn("location", "chosen"),
    "dashboard_age_histogram": _SEGMENT + _CHOSEN_SEGMENTED + _histogram("age", "chosen", 15),
    "dashboard_income_histogram": _SEGMENT + _CHOSEN_SEGMENTED + _histogram("annual_income", "chosen", 15),
    "dashboard_spend_by_satisfaction": _SEGMENT
    + _CHOSEN_SEGMENTED
    + _box("SELECT satisfaction_score, total_spend FROM chosen"),
    "stage_roundtrip": _SEGMENT
    + " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, count(*) AS row_count, {columns} AS column_count,
       CAST(sum(CAST({amount} AS DECIMAL(28,8))) AS DOUBLE) AS amount,
       CAST(sum({" + ".join(f"coalesce(length({t}), 0)" for t in texts)}) AS BIGINT) AS text_length FROM {source}"""
        for stage, columns, amount, texts, source in [
            ("cleaned_transactions", 16, "revenue", ["transaction_id", "product_name", "payment_method"], "tx"),
            ("customer_profiles", 19, "total_spend", ["gender", "location", "churn_status"], "profile"),
            ("segmented_customers", 26, "total_spend", ["location", "RFM_Score", "rfm_segment"], "segmented"),
        ]
    ),
    "stage_roundtrip_csv": _PROFILE + "SELECT * FROM profile",
}
