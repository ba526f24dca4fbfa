"""Numbers out of text, without errors under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number, with single underscores between digits; no type suffix as in 1d.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def parse_number(text: Column) -> Column:
    """A finite double, else null."""
    trimmed = F.trim(text)
    value = F.when(trimmed.rlike(NUMBER), F.regexp_replace(trimmed, "_", "").try_cast("double"))
    return F.when(is_finite(value), value)


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
