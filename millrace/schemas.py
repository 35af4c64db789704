"""Column names of the layers, from the landing file to the star schema."""

from __future__ import annotations

# The landing file's columns, the older names that are accepted for some, and the identity of a line.
BUSINESS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")
ALIASES = {"Invoice": "InvoiceNo", "Price": "UnitPrice", "Customer ID": "CustomerID"}
IDENTITY = ("InvoiceNo", "StockCode", "InvoiceDate", "CustomerID")
PIPELINE_NAME = "online_retail"
BATCH_DAYS = 100

#: Landing column -> staging column.
RAW = dict(zip(BUSINESS, ("invoice_no_raw", "stock_code_raw", "description_raw", "quantity_raw", "invoice_date_raw", "unit_price_raw", "customer_id_raw", "country_raw"), strict=True))

# The columns of the silver tables, in order.
TRANSACTION = (
    "row_hash", "invoice_no", "stock_code", "description", "quantity", "invoice_timestamp", "batch_date", "unit_price", "customer_id", "customer_type",
    "country", "transaction_type", "is_cancelled", "is_return", "line_amount", "source_file", "converted_at", "bronze_loaded_at", "run_start_date", "run_end_date", "silver_loaded_at",
)
SET_ASIDE = ("row_hash", *RAW.values(), "batch_date", "{reason}", "source_file", "run_start_date", "run_end_date", "{time}")
