"""Addresses out of two-column text pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import locate_end, replace_first, slice_text, squish, to_number
from ..operators.relational import natural_join, slice_rows

# Scanning marks removed from an address, each once and in this order.
SCAN_MARKS = ("— ", "~~ ", "~ ", "~", "= ")

COUNTIES = ("Los Angeles", "Orange", "Riverside", "San Bernardino")


def page_lines(pages: DataFrame) -> DataFrame:
    """Page texts (page, text) to numbered lines (page, line_no, line)."""
    return pages.select("page", F.posexplode(F.split("text", "\n")).alias("_at", "line")).select(
        "page", (F.col("_at") + 1).alias("line_no"), "line"
    )


def page_slice(lines: DataFrame, first: int = 6, last: int = 66) -> DataFrame:
    """The table rows of every page: lines ``first``..``last`` in line order."""
    return slice_rows(lines, first, last, by=["page"], order=["line_no", "line"])


def zip_counties(zips: DataFrame, counties: Sequence[str] = COUNTIES) -> DataFrame:
    """ZIP rows (zip, county, state) of the region to (zip, county)."""
    return zips.where(
        (F.col("state") == "CA") & F.col("county").isin(*[f"{c} County" for c in counties])
    ).select(F.col("zip").cast("double").alias("zip"), "county")


def parse_addresses(lines: DataFrame, zips: DataFrame) -> DataFrame:
    """Lines that hold two addresses each to (text, zip, county), one row per address.

    The first address ends five characters after ' CA '. A line without the mark has none.
    """
    end = locate_end(F.col("line"), " CA ")
    halves = lines.select(
        slice_text(F.col("line"), 1, end + 5).alias("left"),
        slice_text(F.col("line"), end + 6, F.length("line")).alias("right"),
    ).unpivot([], ["left", "right"], "side", "text")
    text = squish(F.col("text"))
    for mark in SCAN_MARKS:
        text = replace_first(text, mark, "")
    clean = halves.select(text.alias("text")).where(F.col("text").isNotNull())
    zipped = clean.withColumn(
        "zip", to_number(slice_text(F.col("text"), F.length("text") - 5, F.length("text")))
    )
    return natural_join(zipped, zips, "left")


def addresses_to_geocode(addresses: DataFrame, county: str = "Orange County") -> DataFrame:
    """One county's addresses as (address, zip, county), with a comma before the state."""
    return addresses.where(F.col("county") == county).select(
        replace_first(F.col("text"), " CA", ", CA").alias("address"), "zip", "county"
    )
