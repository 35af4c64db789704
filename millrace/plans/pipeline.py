"""The run: a landing snapshot is prepared, compared with the last committed one, and the dates that changed are
rebuilt through bronze and silver, each batch reconciled and its lines kept as candidates. Then the star schema is
published once for all of them, tested, the candidates are committed, and what the run covers is exported.

On a command line: python -m millrace.plans.pipeline --landing DIR --store DIR [--mode MODE] [--start DAY --end DAY]
[--token TOKEN] [--target DIR]."""

from __future__ import annotations

import argparse
import logging
import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import keyed
from ..operators import calendar, cdc, gold, quality, silver
from ..sources import lake, landing

log = logging.getLogger(__name__)
MODES = ("full_refresh", "incremental", "backfill")
SILVER = {"transactions": silver.transactions, "duplicates": silver.duplicates, "rejects": silver.rejects}
STATE = ("_record_key", "_row_hash", "_batch_date")


def checked_request(mode: str, start: date | None, end: date | None, token: str = "run") -> None:
    """ValueError unless mode is known, a backfill has both dates in order, other modes none, and token is a name."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if (mode == "backfill") != (start is not None and end is not None) or (start is None) != (end is None):
        raise ValueError("a backfill takes a start and an end date, other modes take neither")
    if start is not None and end is not None and start > end:
        raise ValueError("the start date lies after the end date")
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", token):
        raise ValueError("a run token consists of letters, digits, _, . and -")


@dataclass
class Run:
    """A request on a store (a folder with a folder for each table)."""

    spark: SparkSession
    store: str
    mode: str = "incremental"
    start: date | None = None
    end: date | None = None
    token: str = "run"
    target: str | None = None
    done: list[dict] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return f"{self.store.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame | None:
        return lake.read(self.spark, self.path(name)) if lake.has_data(self.spark, self.path(name)) else None

    @contextmanager
    def timed(self, step: str, *of) -> Iterator[None]:
        """Logs a step and adds its time up in seconds."""
        log.info("%s %s begins", step, of)
        began = time.perf_counter()
        try:
            yield
        finally:
            took = time.perf_counter() - began
            self.seconds[step] = round(self.seconds.get(step, 0.0) + took, 3)
            log.info("%s %s ended, elapsed_seconds=%.2f", step, of, took)

    # -- steps --

    def prepare(self, lines: DataFrame) -> tuple[date, date]:
        """Writes the dated lines of the request and, aside, those without a date. First and last date of the run."""
        lines = landing.in_range(lines, self.start, self.end, undated=True).persist()
        valid, invalid = landing.split(lines)
        for name in ("source", "quarantine"):
            lake.delete(self.spark, self.path(name))
        try:
            found = landing.date_range(lines).first()
            if found.invalid_rows:
                invalid.write.parquet(self.path("quarantine"))
            if not found.valid_rows:
                raise ValueError("the snapshot has no line with a date in range")
            log.info("%d dated lines from %s to %s, %d without a date", found.valid_rows, found.min_date, found.max_date, found.invalid_rows)
            valid.repartition("_batch_date").write.partitionBy("_batch_date").parquet(self.path("source"))
        finally:
            lines.unpersist()
        if self.mode == "backfill":
            return self.start, self.end
        first, last = found.min_date, found.max_date
        state = self.table("state")
        if state is not None:  # what has gone from either end of the snapshot is a change too
            held = state.agg(F.min("_batch_date"), F.max("_batch_date")).first()
            first, last = min(first, held[0]), max(last, held[1])
        return first, last

    def detect(self, start: date, end: date) -> tuple[DataFrame, DataFrame | None, list[date]]:
        """Keyed lines of the batch, its events (None where all of it is rebuilt) and the dates to rebuild."""
        current = keyed(landing.in_range(lake.read(self.spark, self.path("source")), start, end)).persist()
        days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
        if self.mode != "incremental":
            return current, None, days
        state = self.table("state")
        held = landing.in_range(state, start, end) if state is not None else current.limit(0)
        events = cdc.events(held, current, self.token).persist()
        return current, events, sorted(r[0] for r in cdc.affected_dates(events).collect())

    def rebuild(self, current: DataFrame, start: date, end: date) -> None:
        """Bronze, silver and fact of the dates start to end, reconciled."""
        days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
        lines = landing.in_range(current, start, end)
        lake.replace_dates(silver.bronze(lines, start, end), self.path("bronze"), "invoice_date", days)
        bronze = self.table("bronze")
        bronze = landing.in_range(bronze, start, end, column="invoice_date") if bronze is not None else lines.limit(0).withColumn("invoice_date", F.col("_batch_date"))
        same = [F.col("_row_hash"), F.col("_batch_date")]
        quality.demand_empty(quality.mismatches(lines.select(*same), bronze.select(*same), ["_batch_date", "_row_hash"]), "snapshot and bronze differ")
        if bronze.isEmpty():
            for name in SILVER:
                lake.replace_dates(self._none(name), self.path(f"silver_{name}"), "batch_date", days) if self.table(f"silver_{name}") is not None else None
            return
        staged = silver.staging(bronze)
        rows = silver.classified(staged).persist()
        for name, part in SILVER.items():
            lake.replace_dates(part(rows), self.path(f"silver_{name}"), "batch_date", days)
        parts = [landing.in_range(t, start, end, column="batch_date") for name in SILVER if (t := self.table(f"silver_{name}")) is not None]
        keys = ["batch_date", "row_hash"]
        quality.demand_empty(quality.mismatches(staged.select(*keys), quality.silver_union(*parts), keys), "staging and silver differ")
        rows.unpersist()

    def _none(self, name: str) -> DataFrame:
        return self.table(f"silver_{name}").limit(0)

    def publish(self, windows: list[tuple[date, date]]) -> dict[str, int]:
        """Dimensions of all silver, and the fact of the windows; the star's tests of these must find nothing."""
        sales = self.table("silver_transactions")
        if sales is None:
            return {}
        dims = {"dim_date": gold.dim_date(sales), "dim_product": gold.dim_product(sales), "dim_country": gold.dim_country(sales)}
        for name, rows in dims.items():
            lake.replace_table(rows.withColumn("gold_loaded_at", F.current_timestamp()), self.path(name))
        star = {name: self.table(name) for name in dims}
        days = [start + timedelta(days=i) for start, end in windows for i in range((end - start).days + 1)]
        fact = gold.fact_sales(_within(sales, "batch_date", windows), *star.values())
        lake.replace_dates(fact.withColumn("gold_loaded_at", F.current_timestamp()), self.path("fact_sales"), "sales_date", days)
        fact = self.table("fact_sales")
        star["fact_sales"] = _within(fact, "sales_date", windows) if fact is not None else gold.measured(sales).limit(0)
        # A sales key holds the line's date, so facts of other dates can't have the same.
        quality.demand_empty(quality.star_checks(star).filter("failures > 0"), "the star schema fails its tests")
        return {name: rows.count() for name, rows in star.items()}

    def candidate(self, current: DataFrame, events: DataFrame | None, days: list[date], batch: tuple[date, date]) -> dict:
        """Writes the batch's lines of these days aside and its events into the history; the manifest entry to be."""
        counts = {r.operation.lower(): r.changes for r in cdc.change_counts(events).collect()} if events is not None else {}
        baseline = events is None or self.table("state") is None
        if events is not None and days:
            events.write.mode("overwrite").parquet(self.path(f"history/run_token={self.token}/batch={batch[0]}"))
        state = current.select(*STATE, *[c for c in current.columns if c not in STATE]).filter(F.col("_batch_date").isin(days)) if days else None
        if state is not None:
            lake.replace_dates(state, self.path("candidate"), "_batch_date", days)
        return {"run_token": self.token, "mode": self.mode, "start_date": batch[0], "end_date": batch[1], "baseline_created": baseline, "affected_dates": [str(d) for d in days] if events is not None else [], "change_counts": {k: counts.get(k, 0) for k in ("insert", "update", "delete")}, "committed": False}

    def commit(self, batches: list[tuple[dict, list[date]]]) -> None:
        """Takes the candidates into the state, then says so in the manifest of each batch; a run that ends before finds
        the same changes again."""
        days = [d for _, of in batches for d in of]
        candidate, state = self.table("candidate"), self.table("state")
        if candidate is None and state is not None:
            candidate = state.limit(0)
        if days and candidate is not None:
            lake.replace_dates(candidate, self.path("state"), "_batch_date", days)
        for entry, _ in batches:
            self.done.append(entry | {"committed": True, "seconds": dict(self.seconds)})
            lake.write_manifest(self.spark, self.path(f"manifest/{self.token}-{entry['start_date']}.json"), self.done[-1])

    def go(self, lines: DataFrame) -> list[dict]:
        """The whole run over a snapshot's lines; the manifest entries of its batches."""
        checked_request(self.mode, self.start, self.end, self.token)
        tables = ("state", "bronze", "fact_sales", "dim_date", "dim_product", "dim_country", *[f"silver_{n}" for n in SILVER])
        for name in tables:
            lake.recover(self.spark, self.path(name))
        lake.delete(self.spark, self.path("candidate"))
        held: list[DataFrame] = []
        try:
            with self.timed("prepare"):
                first, last = self.prepare(lines)
            if self.mode == "full_refresh":
                for name in tables:
                    lake.delete(self.spark, self.path(name))
            batches, windows = [], []
            for batch in calendar.batches(first, last):
                with self.timed("detect", *batch):
                    current, events, days = self.detect(*batch)
                held = [rows for rows in (current, events) if rows is not None]
                own = calendar.windows(days) if events is not None else [batch]
                for window in own if days else []:
                    with self.timed("rebuild", *window):
                        self.rebuild(current, *window)
                windows += own if days else []
                with self.timed("candidate", *batch):
                    batches.append((self.candidate(current, events, days, batch), days))
                while held:
                    held.pop().unpersist()
            if windows:
                with self.timed("publish"):
                    self.publish(windows)
            with self.timed("commit"):
                self.commit(batches)
            if self.target is not None:
                with self.timed("export"):
                    export(self.spark, self.store.rstrip("/"), self.target.rstrip("/"), first, last)
        finally:
            for rows in held:
                rows.unpersist()
            for name in ("source", "candidate"):
                lake.delete(self.spark, self.path(name))
        return self.done


def _within(rows: DataFrame, column: str, windows: list[tuple[date, date]]) -> DataFrame:
    """rows of the windows."""
    day = F.col(column)
    inside = [day.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in windows]
    return rows.filter(reduce(lambda x, y: x | y, inside, F.lit(False)))


def export(spark: SparkSession, store: str, target: str, start: date, end: date) -> dict[str, int]:
    """Copies the published tables, those by date for start to end; rows written. Tables that aren't there are left out."""
    by_date = {f"silver_{n}": "batch_date" for n in SILVER} | {"fact_sales": "sales_date"}
    written = {}
    for name in (*by_date, "dim_date", "dim_product", "dim_country"):
        if not lake.exists(spark, f"{store}/{name}"):
            continue
        rows = lake.read(spark, f"{store}/{name}")
        if column := by_date.get(name):
            rows = landing.in_range(rows, start, end, column=column)
            days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
            lake.replace_dates(rows, f"{target}/{name}", column, days)
        else:
            lake.replace_table(rows, f"{target}/{name}")
        written[name] = rows.count()
    return written


def main(args: list[str] | None = None) -> int:
    """The command line; 0 if the run ended well."""
    parser = argparse.ArgumentParser(prog="millrace", description="Runs a landing snapshot through the store.")
    for name in ("landing", "store"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--mode", choices=MODES, default="incremental")
    for name in ("start", "end"):
        parser.add_argument(f"--{name}", type=date.fromisoformat)
    parser.add_argument("--token", default="run")
    parser.add_argument("--target")
    given = parser.parse_args(args)
    try:
        checked_request(given.mode, given.start, given.end, given.token)
    except ValueError as wrong:
        parser.error(str(wrong))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = Run(spark, given.store, given.mode, given.start, given.end, given.token, given.target)
    for entry in run.go(landing.read(spark, given.landing)):
        log.info("%s", entry)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
