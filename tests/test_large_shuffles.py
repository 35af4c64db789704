"""What queries over whole tables move between tasks: lines once, and without digests, which don't compress."""

import random
import re

from pyspark.sql import functions as F

from millrace.functions.keys import keyed, together
from millrace.operators import cdc, gold, silver
from millrace.plans.queries import QUERIES, _state
from millrace.schemas import IDENTITY
from millrace.sources import lake

from test_operators import SF, classified, line, lines


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_events_of_one_table_equal_events_of_two(spark):
    deal = random.Random(7)
    some = lambda: [line(str(deal.randrange(40)), text=deal.choice(("mug", "jug", None)), quantity=deal.choice("123"), customer=deal.choice(("7", "", None))) for _ in range(300)]
    a = some()
    b = [r for r in a if deal.random() < 0.95] + some()[:15]
    one, two = lines(spark, a), lines(spark, b)
    sides = one.withColumn("_side", F.lit("before")).unionByName(two.withColumn("_side", F.lit("after")))
    got, want = cdc.events_of(together(sides, IDENTITY, "_identity_hash")), cdc.events(keyed(one), keyed(two))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_changes_move_each_line_once(spark):
    for name in ("cdc_events", "cdc_payload_json", "cdc_change_counts", "cdc_affected_dates", "change_windows"):
        found = plan(QUERIES[name](spark, SF))
        assert len(re.findall(r"FileScan parquet \[l_orderkey", found)) == 1, name
    found = plan(QUERIES["record_keys"](spark, SF))
    assert "Exchange hashpartitioning(sha2(" in found and "Exchange hashpartitioning(_identity_hash" not in found


def test_fact_guards_leave_the_fact_where_it_is(spark):
    found = plan(QUERIES["fact_sales"](spark, SF))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", found)) == 1
    assert "LeftSemi" not in found and "Exchange hashpartitioning(sha2(" in found and "Exchange hashpartitioning(row_hash" not in found


def test_fact_without_keys_that_dimensions_lack(spark, monkeypatch):
    sales = silver.transactions(classified(spark, [line(), line("2", "B"), line("3", "D", country="Spain"), line("4", "E")]))
    sales = sales.withColumn("stock_code", F.when(F.col("stock_code") != "E", F.col("stock_code")))  # a null key
    dims = gold.dim_date(sales), gold.dim_product(sales).filter("stock_code <> 'B'"), gold.dim_country(sales).filter("country_name <> 'Spain'")
    want = gold.measured(sales)
    for key, dim in zip(("date_key", "product_key", "country_key"), dims, strict=True):
        want = want.join(dim.select(key), key, "left_semi")
    want = sorted(r.sales_key for r in want.collect())
    for few in (gold.FEW, 1):
        monkeypatch.setattr(gold, "FEW", few)
        assert sorted(r.sales_key for r in gold.fact_sales(sales, *dims).collect()) == want and len(want) == 1


def test_shuffle_files_go_with_what_made_them(spark, tmp_path):
    def held() -> int:
        return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    rows, name = spark.range(1000).repartition(3, "id"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(name)
    with lake.tidy(spark):
        rows.write.parquet(str(tmp_path / "a"))
        assert held() <= before
    assert spark.conf.get(name) == setting


def test_state_holds_hashes_as_bytes(spark):
    state = _state(keyed(lines(spark, [line()])))
    assert [len(state.first()[c]) for c in ("_record_key", "_row_hash")] == [32, 32]
