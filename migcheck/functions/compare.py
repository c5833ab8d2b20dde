"""Format-aware equality of values that changed their form in a migration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months in the written form of a date.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Texts read as booleans.
BOOLEANS = {"y": True, "n": False, "true": True, "false": False, "1": True, "0": False}

#: The accepted forms of a date: year first, perhaps with a time of day; month, day and year by slashes; month written out.
ISO = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T](?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01]))?$"
SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
WRITTEN = r"^([A-Za-z]+) +(\d{1,2}), +(\d{4})$"


def shortened(value: Column, most: int, mark: str = "") -> Column:
    """A text cut to ``most`` characters, with ``mark`` behind it where something was cut."""
    text = value.cast("string")
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def parse_date(value: Column) -> Column:
    """The date of a text in one of the accepted forms, else null; two-digit years from 69 on are of the 1900s.

    The form is told by its pattern and rewritten year first, so that only one cast is tried.
    """
    text = F.trim(value.cast("string"))
    year = F.regexp_extract(text, SLASHES, 3)
    century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
    slashes = F.concat(century, year, F.lit("-"), F.regexp_replace(text, SLASHES, "$1-$2"))
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.regexp_extract(text, WRITTEN, 1)))
    written = F.concat(F.regexp_extract(text, WRITTEN, 3), F.lit("-"), month.cast("string"), F.lit("-"), F.regexp_extract(text, WRITTEN, 2))
    first = F.when(text.rlike(ISO), F.regexp_extract(text, ISO, 1)).when(text.rlike(SLASHES), slashes).when(text.rlike(WRITTEN), written)
    return first.try_cast("date")


def parse_boolean(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return reduce(lambda when, kv: when.when(text == kv[0], F.lit(kv[1])), list(BOOLEANS.items())[1:], F.when(text == "y", True))


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\D", "")


def parsed(value: Column) -> Column:
    """A value's readings: text (trimmed, without case), truth, day, number and digits; null for null."""
    text = value.cast("string")
    return F.when(
        value.isNotNull(),
        F.struct(
            F.lower(F.trim(text)).alias("text"),
            parse_boolean(text).alias("truth"),
            parse_date(text).alias("day"),
            text.try_cast("double").alias("number"),
            digits_only(text).alias("digits"),
        ),
    )


def same_reading(a: Column, b: Column, tolerance: float = 0.001, least_digits: int = 7) -> Column:
    """Whether two results of :func:`parsed` mean the same; the first rule that applies to both decides.

    Nulls, booleans, dates, the digits of long numbers such as phones, numbers within the tolerance,
    then trimmed text without case.  Never null.
    """
    return (
        F.when(a.isNull() & b.isNull(), True)
        .when(a.isNull() | b.isNull(), False)
        .when(a["truth"].isNotNull() & b["truth"].isNotNull(), a["truth"] == b["truth"])
        .when(a["day"].isNotNull() & b["day"].isNotNull(), a["day"] == b["day"])
        .when((F.length(a["digits"]) >= least_digits) & (a["digits"] == b["digits"]), True)
        .when(a["number"].isNotNull() & b["number"].isNotNull(), F.abs(a["number"] - b["number"]) < tolerance)
        .otherwise(a["text"] == b["text"])
    )


def equivalent(a: Column, b: Column, tolerance: float = 0.001, least_digits: int = 7) -> Column:
    """:func:`same_reading` of two values; where many are compared, project :func:`parsed` first, so that each is read once."""
    return same_reading(parsed(a), parsed(b), tolerance, least_digits)
