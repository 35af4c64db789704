from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import parsing
from millrace.functions.keys import keyed
from millrace.operators import bi, calendar, cdc, gold, quality, silver
from millrace.schemas import BUSINESS
from millrace.sources import lake, landing

DAY = date(2009, 12, 1)
SF = "/root/testdata/sf0.001"


def lines(spark, rows):
    schema = ", ".join(f"{c} string" for c in BUSINESS)
    return landing.dated(spark.createDataFrame(rows, schema), "file")


def line(no="1", code="A", text="mug", quantity="1", when="2009-12-01 07:45:00", price="1.5", customer="7", country="France"):
    return (no, code, text, quantity, when, price, customer, country)


def classified(spark, rows):
    return silver.classified(silver.staging(silver.bronze(lines(spark, rows), DAY, DAY)))


def test_values(spark):
    rows = [("+5", 5, None), ("-5", -5, None), ("5.0", None, Decimal("5.0000")), ("abc", None, None), ("", None, None), ("5\n", None, None), (".5", None, Decimal("0.5000")), ("5.", None, None), ("1.00005", None, Decimal("1.0001")), ("1e3", None, None), ("9" * 30, None, None), (None, None, None)]
    out = spark.createDataFrame([(r[0],) for r in rows], "t string").select("t", parsing.integer(F.col("t")), parsing.price(F.col("t"))).collect()
    for (text, whole, money), got in zip(rows, out, strict=True):
        assert got[1] == whole, text
        assert got[2] == (money if whole is None else Decimal(whole)), text


def test_times(spark):
    good = ["12/1/2009 7:45", "12/1/2009 7:45:00", "2009-12-01 7:45:00", "2009-12-01 07:45:00"]
    bad = ["2009-12-01 07:45", "13/1/2009 7:45", "2/30/2010 1:00", " 12/1/2009 7:45", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in good + bad], "t string").select(parsing.timestamp(F.col("t"))).collect()]
    assert got == [datetime(2009, 12, 1, 7, 45)] * len(good) + [None] * len(bad)


def test_rules_types_and_defaults(spark):
    rows = [line("C1", quantity="-2"), line("c1", quantity="2"), line("2", quantity="-2"), line("3", quantity="2"), line("4", quantity="0", price="-1"), line(" ", " ", quantity="x", price="5."), line("5", text=" ", customer="", country=None)]
    got = {r.invoice_no_raw: r for r in classified(spark, rows).collect()}
    assert [(got[k].transaction_type, got[k].is_cancelled, got[k].is_return) for k in ("C1", "c1", "2", "3")] == [("CANCELLATION", True, True), ("CANCELLATION", True, False), ("RETURN", False, True), ("SALE", False, False)]
    assert got["4"].reject_reason == "ZERO_QUANTITY;NEGATIVE_UNIT_PRICE"
    assert got[" "].reject_reason == "MISSING_INVOICE_NO;MISSING_STOCK_CODE;INVALID_QUANTITY;INVALID_UNIT_PRICE"
    assert (got["5"].description, got["5"].country, got["5"].customer_id, got["5"].customer_type, got["5"].reject_reason) == ("UNKNOWN_PRODUCT", "UNKNOWN", None, "GUEST", None)


def test_split_is_disjoint_and_whole(spark):
    rows = [line(), line(), line(), line(text=" mug "), line(quantity="x"), line(quantity="x")]
    all_ = classified(spark, rows)
    parts = [silver.transactions(all_), silver.duplicates(all_), silver.rejects(all_)]
    assert [p.count() for p in parts] == [2, 2, 2]
    assert [r.duplicate_rank for r in parts[1].orderBy("duplicate_rank").collect()] == [2, 3]
    assert quality.mismatches(all_, quality.silver_union(*parts), ["batch_date", "row_hash"]).count() == 0


def test_changes(spark):
    a = [line(str(i)) for i in range(6)] + [line("9", quantity=q) for q in "123"]
    b = [line(str(i), text="jug" if i == 2 else "mug") for i in range(1, 7)] + [line("9", quantity=q) for q in "13"]
    one, two = keyed(lines(spark, a)), keyed(lines(spark, b))
    there = {r.operation: r.changes for r in cdc.change_counts(cdc.events(one, two)).collect()}
    back = {r.operation: r.changes for r in cdc.change_counts(cdc.events(two, one)).collect()}
    assert there["INSERT"] == 1 and there["DELETE"] == 2 and 1 <= there["UPDATE"] <= 3
    assert back == {"INSERT": there["DELETE"], "DELETE": there["INSERT"], "UPDATE": there["UPDATE"]}
    assert cdc.events(one, one).count() == 0
    assert {r.operation for r in cdc.events(one.limit(0), one).collect()} == {"INSERT"}
    assert cdc.events(one.limit(0), one).first().before_payload == "{}"


def test_calendar(spark):
    days = gold.dim_date(spark.createDataFrame([(date(2010, 1, 3),), (date(2009, 12, 5),)], "batch_date date")).orderBy("full_date").collect()
    assert [(d.day_of_week, d.week_of_year, d.is_weekend, d.day_name, d.month_name) for d in days] == [(6, 49, True, "Saturday", "December"), (7, 53, True, "Sunday", "January")]
    plan = calendar.batches(date(2009, 12, 1), date(2011, 12, 9))
    assert len(plan) == 8 and plan[2] == (date(2010, 6, 19), date(2010, 9, 26)) and plan[-1][1] == date(2011, 12, 9)
    bounds = spark.createDataFrame([(date(2009, 12, 1), date(2011, 12, 9))], "min_date date, max_date date")
    assert sorted(map(tuple, calendar.batch_table(spark, bounds).collect())) == plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40)))
def test_windows(offsets):
    days = [date.fromordinal(733_000 + i) for i in offsets]
    got = calendar.windows(days)
    assert [d for a, b in got for d in map(date.fromordinal, range(a.toordinal(), b.toordinal() + 1))] == sorted(set(days))
    assert all((b[0] - a[1]).days > 1 for a, b in zip(got, got[1:], strict=False))


def test_lake(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, date(2020, 1, 1 + i % 4)) for i in range(8)], "v int, d date")
    lake.replace_dates(rows, path, "d", [])
    inside = lake.read(spark, path).filter("d <= '2020-01-02' AND v > 1")
    lake.replace_dates(inside, path, "d", [date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 3)])
    assert sorted(r.v for r in lake.read(spark, path).collect()) == [3, 4, 5, 7]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, lake.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, lake.inserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert [r.k for r in lake.without_orphans(old, "v", new.withColumn("v", F.lit("b")), "v").collect()] == [2]
    assert [r.v for r in lake.without_range(rows, "d", date(2020, 1, 1), date(2020, 1, 3)).orderBy("v").collect()] == [3, 7]
    lake.write_manifest(spark, str(tmp_path / "m.json"), {"a": DAY})
    assert lake.read_manifest(spark, str(tmp_path / "m.json")) == {"a": "2009-12-01"}


def test_landing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        landing.discover(str(tmp_path))
    (tmp_path / "a.csv").write_text('InvoiceNo,StockCode\n1,"x ""y"""\n')
    with pytest.raises(ValueError, match="Quantity"):
        landing.read(spark, str(tmp_path))
    (tmp_path / "b.CSV").write_text("")
    with pytest.raises(RuntimeError):
        landing.discover(str(tmp_path))


def test_checks_find_what_is_wrong(spark):
    sales = silver.transactions(classified(spark, [line(), line("2", "B")]))
    star = {"dim_date": gold.dim_date(sales), "dim_product": gold.dim_product(sales), "dim_country": gold.dim_country(sales)}
    star["fact_sales"] = gold.fact_sales(sales, *star.values())
    assert {r.failures for r in quality.star_checks(star).collect()} == {0}
    star["dim_product"] = star["dim_product"].filter("stock_code = 'A'").unionByName(star["dim_product"].filter("stock_code = 'A'"))
    wrong = {r.test for r in quality.star_checks(star).filter("failures > 0").collect()}
    assert wrong == {"unique dim_product.product_key", "unique dim_product.stock_code", "relationship product_key"}
    with pytest.raises(quality.CheckFailed):
        quality.demand_empty(sales, "rows")


def test_questions_add_up(spark):
    rows = [line("1", quantity="2"), line("2", quantity="-1"), line("C3", quantity="-1", customer=""), line("4", "B", quantity="3", country="Spain", when="1/5/2010 9:00")]
    sales = silver.transactions(classified(spark, rows))
    fact = gold.measured(sales)
    for r in bi.country_sales(fact, gold.dim_country(sales)).collect() + bi.monthly_trend(fact, gold.dim_date(sales)).collect():
        assert r.gross_sales + r.adjustments == r.net_sales
    rates = bi.product_adjustment_rate(fact, gold.dim_product(sales)).collect()
    assert [(r.stock_code, str(r.adjustment_rate), r.adjusted_units) for r in rates] == [("A", "1.0000", 2), ("B", "0.0000", None)]
    assert [tuple(r) for r in bi.top_returned(fact, gold.dim_product(sales)).collect()] == [("mug (A)", 2)]


def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from millrace.plans.queries import QUERIES
    from millrace.plans.sql import ORACLES

    db = duckdb.connect()
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("bi_country_sales", "bi_product_adjustment_rate", "classified_counts", "cdc_events", "dim_date", "dq_star_tests", "reconcile_hashes", "change_windows", "batch_plan"):
        want = db.sql(ORACLES[name])
        got = QUERIES[name](spark, SF).select(*want.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())), name
    assert set(QUERIES) == set(ORACLES)
