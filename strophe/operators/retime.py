"""Shifting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import let
from strophe.schemas import LINE, SUB_LINE


def shift_syllables(syllables: Column, offset: Column) -> Column:
    return F.transform(syllables, lambda s: s.withField("start_ms", s["start_ms"] - offset).withField("end_ms", s["end_ms"] - offset))


def _shift(x: Column, offset: Column) -> Column:
    return x.withField("start_ms", x["start_ms"] - offset).withField("end_ms", x["end_ms"] - offset).withField("syllables", shift_syllables(x["syllables"], offset))


def shift_lines(lines: Column, offset: Column) -> Column:
    """All times, also those of lines under lines, ``offset`` milliseconds earlier; a null offset moves nothing."""

    def moved(found: Column, by: Column) -> Column:
        def one(x: Column) -> Column:
            return _shift(x, by).withField("sub_line", F.when(x["sub_line"].isNotNull(), _shift(x["sub_line"], by)).cast(SUB_LINE)).cast(LINE)

        return F.when(by == 0, found).otherwise(F.transform(found, one))

    return let(F.coalesce(offset, F.lit(0)), lambda by: let(lines.cast(f"array<{LINE}>"), lambda found: moved(found, by)))
