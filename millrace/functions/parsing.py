"""Column expressions that turn the landing file's text into values; what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted time formats in order, and what an integer and a decimal look like.
TIME_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd H:mm:ss")
INTEGER = r"\A[+-]?[0-9]+\z"
DECIMAL = r"\A[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)\z"
PRICE = "decimal(18,4)"


def timestamp(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def filled(text: Column) -> Column:
    """text without blanks at its ends; null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def integer(text: Column) -> Column:
    return F.when(F.trim(text).rlike(INTEGER), F.trim(text).try_cast("long"))


def price(text: Column) -> Column:
    return F.when(F.trim(text).rlike(DECIMAL), F.trim(text).try_cast(PRICE))
