"""Attribute headers: the leading [key:value] lines of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.model import metadata
from strophe.functions.text import let, to_int, trim

BOM = "﻿"


def text_lines(c: Column) -> Column:
    """Lines of a text without its byte order mark."""
    return F.split(F.regexp_replace(c, f"^{BOM}", ""), r"\r?\n", -1)


def is_attribute(line: Column) -> Column:
    """[ first, ] last and a colon between them, whatever white space is around."""
    return line.rlike(r"(?sU)^\s*\[.*:.*\]\s*\z")


def key_value(line: Column) -> Column:
    """Key and value, split at the first colon."""
    t = trim(line)
    return F.struct(F.regexp_extract(t, r"^\[([^:]*):", 1).alias("key"), F.regexp_extract(t, r"^\[[^:]*:(.*)\]$", 1).alias("value"))


def header_size(lines: Column) -> Column:
    """How many lines at the beginning are attributes."""
    return let(F.array_position(F.transform(lines, is_attribute), F.lit(False)), lambda first: F.when(first == 0, F.size(lines)).otherwise(first - 1).cast("int"))


def with_header(lines: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the header's (key, value) pairs, in order (keys may repeat), and of the lines after it."""

    def cut(found: Column, n: Column) -> Column:
        rest = F.slice(found, n + 1, F.greatest(F.size(found) - n, F.lit(0)))
        return let(F.transform(F.slice(found, F.lit(1), n), key_value), lambda attrs: use(attrs, rest))

    return let(lines, lambda found: let(header_size(found), lambda n: cut(found, n)))


def attributes(lines: Column) -> Column:
    return with_header(lines, lambda attrs, _: attrs)


def body(lines: Column) -> Column:
    return with_header(lines, lambda _, rest: rest)


def last_value(attrs: Column, key: str) -> Column:
    return F.try_element_at(F.filter(attrs, lambda a: a["key"] == key), F.lit(-1))["value"]


def last_int(attrs: Column, key: str) -> Column:
    """The last value of a key that is a whole number."""
    numbers = F.filter(F.transform(F.filter(attrs, lambda a: a["key"] == key), lambda a: to_int(a["value"])), lambda v: v.isNotNull())
    return F.try_element_at(numbers, F.lit(-1))


def header_metadata(attrs: Column) -> Column:
    return metadata(title=last_value(attrs, "ti"), artist=last_value(attrs, "ar"), album=last_value(attrs, "al"), duration_ms=last_int(attrs, "length"))


def offset(attrs: Column) -> Column:
    return last_int(attrs, "offset")


def kept_attributes(attrs: Column) -> Column:
    """All but the hash, which has a field of its own."""
    return F.filter(attrs, lambda a: a["key"] != "hash")
