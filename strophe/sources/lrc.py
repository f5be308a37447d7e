"""LRC: lines under one or more [mm:ss.xx] stamps.

Stamps are [mm:ss], [mm:ss.f] to [mm:ss.fff] or [mm:ss:xx]; a line with several stamps is a line for each. An offset
tag moves the lines after it; it may be signed. Stamps stand at the beginning of a line and do not cross line ends.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions import model
from strophe.functions.text import let, to_int, trim
from strophe.schemas import LINE, PARSED, struct
from strophe.sources.headers import is_attribute, key_value, last_int, last_value, text_lines

STAMP = r"\[(\d+):(\d+)(?:[.:](\d{1,3}))?\]"
_STAMPS = rf"^(?:\s*{STAMP})+"


def _head(line: Column) -> Column:
    """The stamps at the beginning of a line; empty without any."""
    return F.regexp_extract(line, f"({_STAMPS})", 1)


def stamp_times(head: Column) -> Column:
    """Milliseconds of stamps that follow each other."""
    part = lambda g: F.regexp_extract_all(head, F.lit(STAMP), F.lit(g))
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    zipped = F.arrays_zip(part(1).alias("m"), part(2).alias("s"), part(3).alias("f"))
    return F.transform(zipped, lambda p: number(p["m"]) * 60000 + number(p["s"]) * 1000 + number(F.rpad(F.coalesce(p["f"], F.lit("")), 3, "0")))


def timed(lines: Column, offsets: bool = True) -> Column:
    """Timed lines of the text lines, in order of time."""

    def with_moves(found: Column, moves: Column | None) -> Column:
        def one(x: Column, i: Column) -> Column:
            shift = F.lit(0)
            if moves is not None:
                shift = F.when(F.size(moves) == 0, F.lit(0)).otherwise(F.coalesce(F.try_element_at(F.filter(moves, lambda m: m["i"] < i), F.lit(-1))["v"], F.lit(0)))
            return let(_head(x), lambda head: F.when(head == "", None).otherwise(let(shift, lambda by: F.transform(stamp_times(head), lambda t: F.struct((t - by).alias("t"), i.alias("i"), trim(F.substring(x, F.char_length(head) + 1, F.char_length(x))).alias("text"))))))

        rows = F.flatten(F.filter(F.transform(found, one), lambda r: r.isNotNull()))
        # Lines of one stamp stay in their order; those of one line with the same time are equal.
        return F.transform(F.array_sort(rows), lambda r: model.line(r["text"], r["t"])).cast(f"array<{LINE}>")

    def moves_of(found: Column) -> Column:
        at = F.transform(found, lambda x, i: F.struct(i.alias("i"), F.when(x.contains("[offset:"), to_int(F.regexp_extract(trim(x), r"^\[offset:([^\]]*)\]$", 1))).alias("v")))
        return F.filter(at, lambda m: m["v"].isNotNull())

    if not offsets:
        return let(lines, lambda found: with_moves(found, None))
    return let(lines, lambda found: let(moves_of(found), lambda moves: with_moves(found, moves)))


def parse(c: Column) -> Column:
    """A document: attributes anywhere, line-synced."""

    def made(lines: Column, attrs: Column) -> Column:
        meta = model.metadata(title=last_value(attrs, "ti"), artist=last_value(attrs, "ar"), album=last_value(attrs, "al"), duration_ms=last_int(attrs, "length"))
        return struct(PARSED, lyrics_type="lrc", sync_type="LineSynced", metadata=meta, additional_info=model.general_info(attrs), lines=timed(lines))

    attributes = lambda lines: F.transform(F.filter(lines, lambda x: is_attribute(x) & (_head(x) == "")), key_value)
    return let(text_lines(c), lambda lines: let(attributes(lines), lambda attrs: made(lines, attrs)))


def parse_lines(c: Column) -> Column:
    """Only the lines; attributes and offsets are ignored."""
    return timed(text_lines(c), offsets=False)
