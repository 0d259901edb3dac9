"""Column helpers that keep the missing-value rules of the source analysis.

Three rules differ from plain Spark SQL and are easy to lose:

* a condition that is NULL gives NULL, not the "else" branch (``if_else``);
* ``sum``/``mean``/``min`` over a group with a missing value are missing
  (``sum_strict`` and friends);
* rounding is half-to-even, also at negative digits (``half_even``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def if_else(condition: Column, yes, no) -> Column:
    """Two-way choice; a NULL condition gives NULL."""
    return F.when(condition, _lit(yes)).when(~condition, _lit(no))


def first_match(cases: Iterable[tuple[Column, object]], default=None) -> Column:
    """First true condition wins; a NULL condition falls through to the next."""
    out = None
    for condition, value in cases:
        out = F.when(condition, _lit(value)) if out is None else out.when(condition, _lit(value))
    return out if default is None else out.otherwise(_lit(default))


def _strict(aggregate: Column, value: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def sum_strict(value: Column) -> Column:
    return _strict(F.sum(value), value)


def mean_strict(value: Column) -> Column:
    return _strict(F.avg(value), value)


def min_strict(value: Column) -> Column:
    return _strict(F.min(value), value)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def to_number(text: Column) -> Column:
    """Text to double, NULL where the text is not a number (no suffix letters accepted)."""
    text = text.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def slice_text(text: Column, first, last) -> Column:
    """Characters ``first``..``last``, 1-based and inclusive; ``first`` below 1 means 1.

    A missing position gives NULL.
    """
    first, last = _lit(first), _lit(last)
    start = F.when(first < 1, F.lit(1)).otherwise(first)
    length = F.when(last < first, F.lit(0)).otherwise(last - start + 1)
    return F.substr(text, start, length)


def locate_end(text: Column, pattern: str) -> Column:
    """Position of the last character of the first occurrence, NULL if absent."""
    at = F.instr(text, pattern)
    return F.when(at > 0, at + F.lit(len(pattern) - 1))


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first occurrence of a plain string only.

    One reference to ``text``, so that replacements can be nested.
    """
    quoted = "".join("\\" + c if c in "\\$" else c for c in replacement)
    return F.regexp_replace(text, f"(?s)^(.*?){re.escape(pattern)}", "$1" + quoted)


def parse_date(text: Column, pattern: str = "M/d/yyyy") -> Column:
    """Month/day/year text to a date; NULL where it is none."""
    return F.try_to_timestamp(F.trim(text), F.lit(pattern)).cast("date")


def year_of(date: Column) -> Column:
    return F.year(date).cast("double")


def squish(text: Column) -> Column:
    """Trim, and collapse inner white space to one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def paste(*parts: Column) -> Column:
    """Join with blanks; a missing part is written as 'NA'."""
    return F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def snake_case(name: str) -> str:
    """One header in snake case: 'NOx_TOTEX' -> 'n_ox_totex', 'Shape__Area' -> 'shape_area'."""
    name = name.replace("%", "_percent_").replace("#", "_number_")
    name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower()
    return f"x{name}" if name[:1].isdigit() or not name else name


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case all headers; a repeated name gets a running number. Metadata only."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = snake_case(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def with_cols(df: DataFrame, steps: Iterable[tuple[str, Column]]) -> DataFrame:
    """Add columns one after the other, so later ones see earlier ones."""
    for name, value in steps:
        df = df.withColumn(name, value)
    return df
