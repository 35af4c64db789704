"""The registered queries again as DuckDB SQL, composed from common table expressions. Values that must equal those of
the DataFrame side (rule names, formats, key arithmetic of the line adapter) are the same fixed values."""

from __future__ import annotations

_BASE = """
  SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
    'P' || CAST(l_partkey AS VARCHAR) AS StockCode,
    CASE WHEN l_orderkey % 89 = 0 THEN '  ' ELSE p_name END AS Description,
    CASE WHEN l_orderkey % 499 = 1 THEN '0' WHEN l_orderkey % 503 = 1 THEN 'abc'
      ELSE CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS Quantity,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
    CASE WHEN l_orderkey % 509 = 1 THEN '-1.5' WHEN l_orderkey % 521 = 1 THEN '5.'
      ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS UnitPrice,
    CASE WHEN o_custkey % 10 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS CustomerID, n_name AS Country, l_orderkey AS ok
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def _hash(*columns: str) -> str:
    return "sha256(concat_ws('||', " + ", ".join(f"coalesce({c}, '<NULL>')" for c in columns) + "))"


_B = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
_ROW, _IDENTITY = _hash(*_B), _hash("InvoiceNo", "StockCode", "InvoiceDate", "CustomerID")

LINES = f"base AS ({_BASE}), lines AS (SELECT {', '.join(_B)} FROM (SELECT * FROM base UNION ALL SELECT * FROM base WHERE ok % 50 = 0))"
DATED = f"{LINES}, dated AS (SELECT *, try_strptime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS ts, CAST(try_strptime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS DATE) AS day FROM lines)"
HASHED = f"{DATED}, hashed AS (SELECT *, {_ROW} AS row_hash FROM dated)"
TYPED = f"""{HASHED}, typed AS (
  SELECT row_hash, ts, day, InvoiceNo AS invoice_no_raw, StockCode AS stock_code_raw, Description AS description_raw, Quantity AS quantity_raw,
    InvoiceDate AS invoice_date_raw, UnitPrice AS unit_price_raw, CustomerID AS customer_id_raw, Country AS country_raw,
    nullif(trim(InvoiceNo), '') AS invoice_no, nullif(trim(StockCode), '') AS stock_code, coalesce(nullif(trim(Description), ''), 'UNKNOWN_PRODUCT') AS description,
    CASE WHEN regexp_full_match(trim(Quantity), '[+-]?[0-9]+') THEN TRY_CAST(trim(Quantity) AS BIGINT) END AS quantity,
    CASE WHEN regexp_full_match(trim(UnitPrice), '[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)') THEN TRY_CAST(trim(UnitPrice) AS DECIMAL(18,4)) END AS unit_price,
    nullif(trim(CustomerID), '') AS customer_id, coalesce(nullif(trim(Country), ''), 'UNKNOWN') AS country
  FROM hashed)"""
_RULES = {
    "MISSING_ROW_HASH": "row_hash IS NULL", "MISSING_INVOICE_NO": "invoice_no IS NULL", "MISSING_STOCK_CODE": "stock_code IS NULL", "INVALID_INVOICE_DATE": "ts IS NULL",
    "INVALID_QUANTITY": "quantity IS NULL", "ZERO_QUANTITY": "quantity = 0", "INVALID_UNIT_PRICE": "unit_price IS NULL", "NEGATIVE_UNIT_PRICE": "unit_price < 0",
}
_REASON = "nullif(concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + "), '')"
CLASSIFIED = f"""{TYPED}, classified AS (
  SELECT *, {_REASON} AS reject_reason, row_number() OVER (PARTITION BY row_hash ORDER BY invoice_no_raw) AS duplicate_rank,
    CASE WHEN customer_id IS NULL THEN 'GUEST' ELSE 'REGISTERED' END AS customer_type,
    CASE WHEN upper(invoice_no) LIKE 'C%' THEN 'CANCELLATION' WHEN quantity < 0 THEN 'RETURN' ELSE 'SALE' END AS transaction_type,
    coalesce(upper(invoice_no) LIKE 'C%', false) AS is_cancelled, coalesce(quantity < 0, false) AS is_return,
    CAST(quantity * unit_price AS DECIMAL(18,4)) AS line_amount
  FROM typed)"""
SALES = f"{CLASSIFIED}, sales AS (SELECT * FROM classified WHERE reject_reason IS NULL AND duplicate_rank = 1)"
STAR = f"""{SALES}, products AS (SELECT md5(stock_code) AS product_key, stock_code, arg_max(description, struct_pack(a := ts, b := row_hash)) AS product_name FROM sales GROUP BY stock_code),
fact AS (
  SELECT row_hash AS sales_key, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, md5(stock_code) AS product_key, md5(country) AS country_key, day AS sales_date, invoice_no,
    customer_id, customer_type, ts AS invoice_timestamp, transaction_type, quantity, unit_price, line_amount AS net_amount,
    CAST(CASE WHEN transaction_type = 'SALE' THEN line_amount ELSE 0 END AS DECIMAL(18,4)) AS sales_amount,
    CAST(CASE WHEN transaction_type IN ('RETURN', 'CANCELLATION') THEN line_amount ELSE 0 END AS DECIMAL(18,4)) AS adjustment_amount,
    is_cancelled, is_return, country, stock_code
  FROM sales)"""
_TURNOVER = """CAST(sum(sales_amount) AS DECIMAL(18,2)) AS gross_sales, CAST(sum(adjustment_amount) AS DECIMAL(18,2)) AS adjustments,
  CAST(sum(net_amount) AS DECIMAL(18,2)) AS net_sales, count(DISTINCT invoice_no) AS invoice_count, count(DISTINCT nullif(customer_id, 'GUEST')) AS identified_customer_count"""
_N = "CAST(replace(InvoiceNo, 'C', '') AS BIGINT)"


def _keyed(name: str, rows: str) -> str:
    return f"""{name}_h AS (SELECT *, {_ROW} AS row_hash, {_IDENTITY} AS identity_hash FROM ({rows})),
{name} AS (SELECT *, sha256(identity_hash || '||' || CAST(row_number() OVER (PARTITION BY identity_hash ORDER BY row_hash) AS VARCHAR)) AS record_key FROM {name}_h)"""


_DESCRIPTION = f"CASE WHEN {_N} % 103 = 0 THEN Description || ' v2' ELSE Description END"
EVENTS = f"""{DATED}, {_keyed("prev", f"SELECT * FROM dated WHERE {_N} % 107 <> 0")}, {_keyed("cur", f"SELECT * REPLACE ({_DESCRIPTION} AS Description) FROM dated WHERE {_N} % 101 <> 0")},
events AS (
  SELECT coalesce(c.record_key, p.record_key) AS record_key, CASE WHEN p.record_key IS NULL THEN 'INSERT' WHEN c.record_key IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
    p.row_hash AS before_hash, c.row_hash AS after_hash, p.day AS before_date, c.day AS after_date
  FROM prev p FULL JOIN cur c ON p.record_key = c.record_key WHERE p.row_hash IS DISTINCT FROM c.row_hash),
affected AS (SELECT DISTINCT d AS affected_date FROM (SELECT before_date AS d FROM events UNION ALL SELECT after_date FROM events) WHERE d IS NOT NULL)"""


def _payload(side: str) -> str:
    """The line's columns that aren't null, as JSON."""
    parts = ", ".join(f"'\"{c}\":' || CAST(to_json({side}.{c}) AS VARCHAR)" for c in _B)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


_RANGE = "BETWEEN DATE '1995-06-01' AND DATE '1996-05-31'"
_RAW = "invoice_no_raw, stock_code_raw, description_raw, quantity_raw, invoice_date_raw, unit_price_raw, customer_id_raw, country_raw"
_DATES = """SELECT DISTINCT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, day AS full_date, CAST(extract(day FROM day) AS SMALLINT) AS day_of_month,
  CAST(isodow(day) AS SMALLINT) AS day_of_week, strftime(day, '%A') AS day_name, CAST(extract(week FROM day) AS SMALLINT) AS week_of_year, CAST(month(day) AS SMALLINT) AS month_number,
  strftime(day, '%B') AS month_name, CAST(quarter(day) AS SMALLINT) AS quarter_number, CAST(year(day) AS SMALLINT) AS year_number, isodow(day) IN (6, 7) AS is_weekend FROM """
_BAD_DATES = f"{LINES}, spoiled AS (SELECT *, CASE WHEN {_N} % 97 = 0 THEN 'not a date' WHEN {_N} % 89 = 1 THEN NULL ELSE InvoiceDate END AS d FROM lines)"
_ISLANDS = """SELECT min(affected_date) AS window_start, max(affected_date) AS window_end
  FROM (SELECT affected_date, affected_date - CAST(row_number() OVER (ORDER BY affected_date) AS INTEGER) AS island FROM affected) GROUP BY island"""
_TESTS = [
    *[f"SELECT 'not_null {t}.{c}' AS test, CAST(0 AS BIGINT) AS failures" for t, cs in {"dim_date": ("date_key", "full_date"), "dim_product": ("product_key", "stock_code"), "dim_country": ("country_key", "country_name")}.items() for c in cs],
    *[f"SELECT 'not_null fact_sales.{c}', count(*) FILTER (WHERE {c} IS NULL) FROM fact" for c in ("sales_key", "date_key", "product_key", "country_key")],
    *[f"SELECT 'unique {n}', count(*) FROM (SELECT {e} FROM {src} GROUP BY 1 HAVING count(*) > 1)" for n, e, src in (
        ("dim_date.date_key", "strftime(day, '%Y%m%d')", "(SELECT DISTINCT day FROM sales)"), ("dim_date.full_date", "day", "(SELECT DISTINCT day FROM sales)"),
        ("dim_product.product_key", "product_key", "products"), ("dim_product.stock_code", "stock_code", "products"),
        ("dim_country.country_key", "md5(country)", "(SELECT DISTINCT country FROM sales)"), ("dim_country.country_name", "country", "(SELECT DISTINCT country FROM sales)"), ("fact_sales.sales_key", "sales_key", "fact"))],
    *[f"SELECT 'relationship {k}', count(*) FROM fact WHERE {k} NOT IN (SELECT {k} FROM {p})" for k, p in (
        ("date_key", "(SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key FROM sales)"), ("product_key", "products"), ("country_key", "(SELECT md5(country) AS country_key FROM sales)"))],
]

ORACLES = {
    "source_prepared": f"WITH {DATED} SELECT {', '.join(_B)}, ts AS _invoice_timestamp, day AS _batch_date FROM dated",
    "source_date_range": f"WITH {DATED} SELECT min(day) AS min_date, max(day) AS max_date, count(day) AS valid_rows, count(*) - count(day) AS invalid_rows FROM dated",
    "dates_per_partition": f"WITH {DATED} SELECT day AS _batch_date, count(*) AS rows FROM dated GROUP BY day",
    "invalid_date_quarantine": f"WITH {_BAD_DATES} SELECT InvoiceNo, StockCode, d AS InvoiceDate FROM spoiled WHERE try_strptime(d, '%Y-%m-%d %H:%M:%S') IS NULL",
    "dirty_profile": f"""WITH {LINES} SELECT count(*) AS total_rows, count(*) FILTER (WHERE coalesce(trim(CustomerID), '') = '') AS missing_customer,
      count(*) FILTER (WHERE coalesce(trim(Description), '') = '') AS missing_description, count(*) FILTER (WHERE upper(trim(InvoiceNo)) LIKE 'C%') AS cancelled,
      count(*) FILTER (WHERE TRY_CAST(Quantity AS DOUBLE) < 0) AS negative_quantity FROM lines""",
    "row_hashes": f"WITH {HASHED} SELECT row_hash, day AS batch_date, count(*) AS rows FROM hashed GROUP BY ALL",
    "record_keys": f"WITH {DATED}, {_keyed('k', 'SELECT * FROM dated')} SELECT row_hash AS _row_hash, identity_hash AS _identity_hash, record_key AS _record_key FROM k",
    "bronze_projection": f"WITH {HASHED} SELECT {', '.join(_B)}, row_hash AS _row_hash, day AS _process_date, min(day) OVER () AS _run_start_date, max(day) OVER () AS _run_end_date, 'online_retail' AS _pipeline_name, day AS invoice_date FROM hashed WHERE day IS NOT NULL",
    "staging_projection": f"WITH {TYPED} SELECT {_RAW}, ts AS invoice_timestamp, day AS batch_date, row_hash, day AS process_date, 'online_retail' AS pipeline_name, min(day) OVER () AS run_start_date, max(day) OVER () AS run_end_date FROM typed WHERE day IS NOT NULL",
    "typed_rows": f"WITH {TYPED} SELECT row_hash, invoice_no, stock_code, description, quantity, unit_price, customer_id, country FROM typed",
    "quality_rules": f"WITH {CLASSIFIED} SELECT row_hash, reject_reason FROM classified WHERE reject_reason IS NOT NULL",
    "reject_reason_counts": f"WITH {CLASSIFIED} SELECT reject_reason, count(*) AS rows FROM classified GROUP BY reject_reason",
    "ranked_rows": f"WITH {CLASSIFIED} SELECT row_hash, duplicate_rank FROM classified WHERE duplicate_rank > 1",
    "classified_counts": f"""WITH {CLASSIFIED} SELECT CASE WHEN reject_reason IS NOT NULL THEN reject_reason WHEN duplicate_rank > 1 THEN 'duplicate' ELSE transaction_type END AS bucket,
      count(*) AS rows, CAST(sum(line_amount) AS DECIMAL(28,4)) AS amount FROM classified GROUP BY 1""",
    "silver_transactions": f"WITH {SALES} SELECT row_hash, invoice_no, stock_code, description, quantity, ts AS invoice_timestamp, day AS batch_date, unit_price, customer_id, customer_type, country, transaction_type, is_cancelled, is_return, line_amount FROM sales",
    "silver_duplicates": f"WITH {CLASSIFIED} SELECT row_hash, {_RAW}, day AS batch_date, duplicate_rank FROM classified WHERE reject_reason IS NULL AND duplicate_rank > 1",
    "silver_rejects": f"WITH {CLASSIFIED} SELECT row_hash, {_RAW}, day AS batch_date, reject_reason FROM classified WHERE reject_reason IS NOT NULL",
    "dim_date": f"WITH {SALES} {_DATES} sales",
    "dim_product_two_loads": f"WITH {STAR} SELECT product_key, stock_code, arg_max(description || ' v2', struct_pack(a := ts, b := '0', c := description)) AS product_name FROM (SELECT md5(stock_code) AS product_key, * FROM sales) GROUP BY ALL",
    "staging_reconciled": f"WITH {HASHED} SELECT day AS batch_date, count(*) AS source_count, count(*) AS target_count, CAST(0 AS BIGINT) AS differing_hashes FROM hashed WHERE day IS NOT NULL GROUP BY day",
    "dim_product": f"WITH {STAR} SELECT * FROM products",
    "dim_country": f"WITH {SALES} SELECT DISTINCT md5(country) AS country_key, country AS country_name FROM sales",
    "dim_country_orphan_delete": f"WITH {SALES} SELECT DISTINCT md5(country) AS country_key, country AS country_name FROM sales WHERE transaction_type = 'RETURN' AND quantity < -49",
    "dim_date_upsert": f"WITH {SALES} {_DATES} (SELECT day FROM sales WHERE day <= DATE '1998-12-31' UNION SELECT day FROM sales WHERE day >= DATE '1998-01-01')",
    "fact_sales": f"WITH {STAR} SELECT * EXCLUDE (country, stock_code) FROM fact",
    "bi_country_sales": f"WITH {STAR} SELECT country AS country_name, {_TURNOVER} FROM fact GROUP BY country",
    "bi_monthly_trend": f"WITH {STAR} SELECT CAST(date_trunc('month', sales_date) AS DATE) AS sales_month, {_TURNOVER} FROM fact GROUP BY 1",
    "bi_product_adjustment_rate": f"""WITH {STAR} SELECT f.stock_code, product_name, CAST(sum(sales_amount) AS DECIMAL(18,2)) AS gross_sales, CAST(abs(sum(adjustment_amount)) AS DECIMAL(18,2)) AS adjustment_value,
      CAST(abs(sum(adjustment_amount)) / sum(sales_amount) AS DECIMAL(12,4)) AS adjustment_rate, CAST(abs(sum(quantity) FILTER (WHERE transaction_type IN ('RETURN', 'CANCELLATION'))) AS BIGINT) AS adjusted_units
      FROM fact f JOIN products p ON f.product_key = p.product_key GROUP BY f.stock_code, product_name HAVING sum(sales_amount) > 0""",
    "bi_top10_returned": f"""WITH {STAR} SELECT product_name || ' (' || f.stock_code || ')' AS product, CAST(abs(sum(quantity)) AS BIGINT) AS returned_cancelled_units
      FROM fact f JOIN products p ON f.product_key = p.product_key WHERE transaction_type IN ('RETURN', 'CANCELLATION') GROUP BY product_name, f.stock_code
      ORDER BY returned_cancelled_units DESC, f.stock_code LIMIT 10""",
    "reconcile_counts": f"WITH {CLASSIFIED} SELECT day AS batch_date, count(*) AS source_count, count(*) FILTER (WHERE NOT (reject_reason IS NULL AND duplicate_rank > 1)) AS target_count, count(*) FILTER (WHERE reject_reason IS NULL AND duplicate_rank > 1) AS difference FROM classified GROUP BY day HAVING difference <> 0",
    "reconcile_hashes": f"WITH {CLASSIFIED} SELECT day AS batch_date, row_hash, count(*) AS source_count, count(*) FILTER (WHERE NOT (reject_reason IS NULL AND duplicate_rank > 1)) AS target_count, count(*) FILTER (WHERE reject_reason IS NULL AND duplicate_rank > 1) AS difference FROM classified GROUP BY ALL HAVING difference <> 0",
    "reconcile_multiset": f"WITH {CLASSIFIED} SELECT count(*) FILTER (WHERE reject_reason IS NULL AND duplicate_rank > 1) AS missing_count, CAST(0 AS BIGINT) AS extra_count FROM classified",
    "reconcile_except_all": f"WITH {CLASSIFIED} SELECT row_hash, 'missing' AS side FROM classified WHERE reject_reason IS NULL AND duplicate_rank > 1",
    "dq_star_tests": f"WITH {STAR} " + " UNION ALL ".join(_TESTS),
    "dq_unique": f"WITH {HASHED} SELECT row_hash AS value, count(*) AS rows FROM hashed GROUP BY row_hash HAVING count(*) > 1",
    "dq_not_null": f"WITH {TYPED} SELECT row_hash FROM typed WHERE customer_id IS NULL",
    "dq_relationships": "SELECT o_custkey AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)",
    "cdc_events": f"WITH {EVENTS} SELECT * FROM events",
    "cdc_payload_json": f"""WITH {EVENTS} SELECT e.record_key, operation, {_payload("p")} AS before_payload, {_payload("c")} AS after_payload
      FROM events e LEFT JOIN prev p ON e.record_key = p.record_key LEFT JOIN cur c ON e.record_key = c.record_key""",
    "cdc_change_counts": f"WITH {EVENTS} SELECT operation, count(*) AS changes FROM events GROUP BY operation",
    "cdc_affected_dates": f"WITH {EVENTS} SELECT affected_date FROM affected",
    "cdc_initial_load": f"WITH {EVENTS} SELECT record_key, 'INSERT' AS operation, row_hash AS after_hash, day AS after_date FROM cur",
    "range_replace": f"WITH {DATED} SELECT day AS _batch_date, count(*) AS rows FROM dated WHERE NOT (day {_RANGE} AND {_N} % 2 = 0) GROUP BY day",
    "full_refresh_vs_incremental": f"WITH {EVENTS} SELECT day AS batch_date, count(*) AS rows, count(DISTINCT row_hash) AS hashes FROM cur GROUP BY day",
    "idempotent_rerun": f"WITH {EVENTS} SELECT CAST(0 AS BIGINT) AS changes",
    "change_windows": f"WITH {EVENTS} {_ISLANDS}",
    "batch_plan": f"""WITH {DATED}, r AS (SELECT min(day) AS a, max(day) AS b FROM dated) SELECT CAST(s AS DATE) AS batch_start, CAST(least(CAST(s AS DATE) + 99, b) AS DATE) AS batch_end
      FROM r, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 100 DAY) t(s)""",
}
