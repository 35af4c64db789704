"""Parquet tables: replacing dates, upserts, orphans, and small JSON manifests. Any file system that Spark reaches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _at(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _at(spark, path)
    fs.delete(place, True)


def _before(path: str) -> str:
    """Where what stands at path is kept while another takes its place; Spark's readers pass over such names."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{name}.before"


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves the folder old to new, in place of what is there. That is kept under a known name until the move is done,
    so whatever ends the program in between, recover() puts it back."""
    place, fs = _at(spark, old)
    target, kept = _at(spark, new)[0], _at(spark, _before(new))[0]
    recover(spark, new)
    fs.mkdirs(target.getParent())
    if fs.exists(target) and not fs.rename(target, kept):
        raise OSError(f"can't move {new} aside")
    if not fs.rename(place, target):
        recover(spark, new)
        raise OSError(f"can't move {old} to {new}")
    fs.delete(kept, True)


def recover(spark: SparkSession, path: str) -> None:
    """Ends what an interrupted replacement of path, or of a date of the table there, has left: where the new rows
    are in place the old ones go, where they aren't the old ones return."""
    place, fs = _at(spark, path)
    found = [path] if fs.exists(_at(spark, _before(path))[0]) else []
    if fs.exists(place):
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        found += [f"{path.rstrip('/')}/{n.removeprefix('.').removesuffix('.before')}" for n in names if n.startswith(".") and n.endswith(".before")]
    for one in found:
        kept, target = _at(spark, _before(one))[0], _at(spark, one)[0]
        if fs.exists(target):
            fs.delete(kept, True)
        elif not fs.rename(kept, target):
            raise OSError(f"can't restore {one}")


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table at path; an empty one of the schema, if that is given, where there is none."""
    if schema is not None and not has_data(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether Spark would find files at path; names of partitions may begin with an underscore."""
    place, fs = _at(spark, path)
    return fs.exists(place) and any("=" in (n := s.getPath().getName()) or not n.startswith(("_", ".")) for s in fs.listStatus(place))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is run within it leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)


def replace_dates(rows: DataFrame, path: str, column: str, dates: Iterable[date]) -> None:
    """Puts rows in place of the listed dates of the table. Dates that rows no longer have disappear, which dynamic
    overwriting alone would leave. rows may come from the table itself: they are written beside it first, and what
    takes its place is moved, date by date."""
    spark, aside = rows.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.repartition(F.col(column)).write.partitionBy(column).option("compression", "snappy").parquet(aside)
    place, fs = _at(spark, path)
    fs.mkdirs(place)
    made = {s.getPath().getName() for s in fs.listStatus(_at(spark, aside)[0])}
    for name in sorted({f"{column}={d}" for d in dates} | {m for m in made if m.startswith(f"{column}=")}):
        if name in made:
            rename(spark, f"{aside}/{name}", f"{path}/{name}")
        else:
            delete(spark, f"{path}/{name}")
    delete(spark, aside)


def replace_table(rows: DataFrame, path: str) -> None:
    """Puts rows in place of the whole table, which rows may come from."""
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.option("compression", "snappy").parquet(aside)
    rename(rows.sparkSession, aside, path)


def without_range(rows: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """rows but those dated start to end."""
    return rows.filter(~F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")) | F.col(column).isNull())


def upserted(existing: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """existing with the rows of news in place of those with the same keys."""
    return existing.join(news.select(*keys).distinct(), keys, "left_anti").unionByName(news)


def inserted(existing: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and the rows of news whose keys it doesn't have."""
    return existing.unionByName(news.join(existing.select(*keys).distinct(), keys, "left_anti"))


def without_orphans(dimension: DataFrame, column: str, source: DataFrame, source_column: str) -> DataFrame:
    """The dimension's rows whose value still stands in source."""
    return dimension.join(source.select(F.col(source_column).alias(column)).distinct(), column, "left_semi")


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Writes JSON at once: readers find the old file or the new one, which takes its place in one step."""
    aside = f"{path}.{uuid.uuid4().hex}"
    place, fs = _at(spark, aside)
    out = fs.create(place, True)
    out.write(bytearray(json.dumps(content, indent=2, default=str).encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    option = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.isAbsolute() and place.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(place), fs.makeQualified(_at(spark, path)[0]), option)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
