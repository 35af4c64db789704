from datetime import date

import pytest

from pyspark.sql import functions as F

from millrace.operators import gold, quality
from millrace.plans.pipeline import Run, checked_request, export, main
from millrace.sources import lake, landing

HEAD = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
ROWS = [
    "1,A,mug,2,2009-12-01 07:45:00,1.50,7,France",
    "1,A,mug,2,2009-12-01 07:45:00,1.50,7,France",
    "C2,A,mug,-1,12/2/2009 8:00,1.50,7,France",
    '3,B,"a ""red"" tin",1,2009-12-04 9:00:00,0,,Spain',
    "4,B,tin,0,2009-12-04 09:01:00,-1,8,Spain",
    "5,C,cup,3,no date,2.00,8,Spain",
]


def snapshot(spark, tmp_path, rows):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / "retail.CSV").write_text("﻿" + HEAD + "\n".join(rows) + "\n", encoding="utf-8")
    return landing.read(spark, str(folder))


def go(spark, tmp_path, rows, mode="incremental", token="t", **dates):
    return Run(spark, str(tmp_path / "store"), mode, token=token, **dates).go(snapshot(spark, tmp_path, rows))


def held(spark, tmp_path, name):
    path = str(tmp_path / "store" / name)
    return lake.read(spark, path) if lake.has_data(spark, path) else None


def test_run_edit_revert_and_delete(spark, tmp_path):
    (first,) = go(spark, tmp_path, ROWS)
    assert first["change_counts"] == {"insert": 5, "update": 0, "delete": 0} and first["baseline_created"]
    assert first["affected_dates"] == ["2009-12-01", "2009-12-02", "2009-12-04"]
    assert [held(spark, tmp_path, f"silver_{n}").count() for n in ("transactions", "duplicates", "rejects")] == [3, 1, 1]
    assert held(spark, tmp_path, "silver_rejects").first().reject_reason == "ZERO_QUANTITY;NEGATIVE_UNIT_PRICE"
    assert held(spark, tmp_path, "quarantine").count() == 1
    fact = {r.invoice_no: r for r in held(spark, tmp_path, "fact_sales").collect()}
    assert (fact["C2"].transaction_type, fact["C2"].is_return, str(fact["C2"].adjustment_amount)) == ("CANCELLATION", True, "-1.5000")
    assert (fact["3"].customer_id, fact["3"].customer_type) == (None, "GUEST")
    assert {r.product_name for r in held(spark, tmp_path, "dim_product").collect()} == {"mug", 'a "red" tin'}

    (same,) = go(spark, tmp_path, ROWS)
    assert same["affected_dates"] == [] and sum(same["change_counts"].values()) == 0
    edited = [ROWS[0], ROWS[1], ROWS[2].replace("mug", "big mug"), *ROWS[3:]]
    for rows in (edited, ROWS):
        (entry,) = go(spark, tmp_path, rows)
        assert entry["change_counts"] == {"insert": 0, "update": 1, "delete": 0} and entry["affected_dates"] == ["2009-12-02"]

    # The first and the last date go: products, dates and partitions with them.
    (gone,) = go(spark, tmp_path, [ROWS[2], ROWS[5]])
    assert gone["change_counts"]["delete"] == 4
    assert [r.full_date for r in held(spark, tmp_path, "dim_date").collect()] == [date(2009, 12, 2)]
    assert held(spark, tmp_path, "fact_sales").count() == 1 and held(spark, tmp_path, "silver_duplicates") is None
    manifest = lake.read_manifest(spark, str(tmp_path / "store/manifest/t-2009-12-01.json"))
    assert manifest["committed"] is True


def test_backfill_full_refresh_and_export(spark, tmp_path):
    go(spark, tmp_path, ROWS, "full_refresh")
    before = held(spark, tmp_path, "fact_sales").drop("gold_loaded_at").collect()
    (entry,) = go(spark, tmp_path, ROWS, "backfill", start=date(2009, 12, 2), end=date(2009, 12, 3))
    assert entry["start_date"] == date(2009, 12, 2)
    assert sorted(held(spark, tmp_path, "fact_sales").drop("gold_loaded_at").collect()) == sorted(before)
    counts = export(spark, str(tmp_path / "store"), str(tmp_path / "out"), date(2009, 12, 1), date(2009, 12, 2))
    assert counts["silver_transactions"] == counts["fact_sales"] == 2 and counts["dim_country"] == 2
    with pytest.raises(ValueError, match="no line"):
        go(spark, tmp_path, ROWS[5:])


@pytest.mark.parametrize("bad", [("weekly", None, None), ("backfill", None, None), ("backfill", date(2010, 1, 2), date(2010, 1, 1)), ("incremental", date(2010, 1, 1), date(2010, 1, 2)), ("full_refresh", None, date(2010, 1, 1))])
def test_requests(bad):
    with pytest.raises(ValueError):
        checked_request(*bad)
    with pytest.raises(ValueError):
        checked_request("incremental", None, None, "a/b")


def test_export_at_the_end_and_times(spark, tmp_path):
    run = Run(spark, str(tmp_path / "store"), token="x", target=str(tmp_path / "out"))
    run.go(snapshot(spark, tmp_path, ROWS))
    assert lake.read(spark, str(tmp_path / "out/fact_sales")).count() == 3
    assert {"prepare", "detect", "rebuild", "candidate", "publish", "commit", "export"} == set(run.seconds)
    assert not (tmp_path / "store/source").exists() and not (tmp_path / "store/candidate").exists()


def test_a_failed_run_commits_nothing_and_cleans_up(spark, tmp_path, monkeypatch):
    go(spark, tmp_path, ROWS)
    edited = [ROWS[2].replace("mug", "big mug"), *ROWS[3:]]

    def fail(*_):
        raise quality.CheckFailed("planted")

    with monkeypatch.context() as m:
        m.setattr(Run, "publish", fail)
        with pytest.raises(quality.CheckFailed):
            go(spark, tmp_path, edited)
    assert not (tmp_path / "store/source").exists() and not (tmp_path / "store/candidate").exists()
    assert held(spark, tmp_path, "state").count() == 5
    (again,) = go(spark, tmp_path, edited)  # finds the same changes
    assert again["change_counts"] == {"insert": 0, "update": 1, "delete": 2}


def test_two_loads_of_a_product(spark, tmp_path):
    """At equal times the row loaded later names the product, whatever the hashes."""
    rows = ["1,A,{},2,2009-12-01 07:45:00,1.50,7,France", "9,A,{},2,2009-12-01 07:45:00,1.50,7,France"]
    first = [r.format("old") for r in rows]
    for news in ("aa", "bb", "cc", "dd"):
        go(spark, tmp_path, first, "full_refresh")
        sales = held(spark, tmp_path, "silver_transactions")
        late = sales.limit(1).withColumn("description", F.lit(news)).withColumn("row_hash", F.md5(F.lit(news))).withColumn("silver_loaded_at", F.col("silver_loaded_at") + F.expr("INTERVAL 1 MINUTE"))
        assert gold.dim_product(sales.unionByName(late)).first().product_name == news


def test_an_interrupted_replacement_is_recovered(spark, tmp_path):
    """Between the two moves the old rows stand aside; the next run or replacement puts them back."""
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2020, 1, 2))], "v int, d date")
    lake.replace_dates(rows, path, "d", [])
    (tmp_path / "t/d=2020-01-01").rename(tmp_path / "t/.d=2020-01-01.before")
    assert [r.v for r in lake.read(spark, path).collect()] == [2]
    lake.recover(spark, path)
    assert sorted(r.v for r in lake.read(spark, path).collect()) == [1, 2]
    (tmp_path / "t").rename(tmp_path / ".t.before")
    lake.replace_table(rows.filter("v = 2"), path)
    assert [r.v for r in lake.read(spark, path).collect()] == [2] and not (tmp_path / ".t.before").exists()
    # The new rows are in place and the old ones have not gone yet.
    (tmp_path / ".t.before").mkdir()
    lake.recover(spark, path)
    assert not (tmp_path / ".t.before").exists() and lake.read(spark, path).count() == 1
    for content in ({"a": 1}, {"a": 2}):
        lake.write_manifest(spark, str(tmp_path / "m.json"), content)
    assert lake.read_manifest(spark, str(tmp_path / "m.json")) == {"a": 2}


def test_command_line(spark, tmp_path, monkeypatch):
    snapshot(spark, tmp_path, ROWS)
    for bad in (["--mode", "weekly"], ["--start", "2020-01-01"], ["--mode", "backfill"], ["--token", "a/b"]):
        with pytest.raises(SystemExit):
            main(["--landing", str(tmp_path / "in"), "--store", str(tmp_path / "store"), *bad])
    assert main(["--landing", str(tmp_path / "in"), "--store", str(tmp_path / "store"), "--token", "c"]) == 0
    assert held(spark, tmp_path, "fact_sales").count() == 3
