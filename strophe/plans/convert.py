"""Parsing by dialect, and conversion between dialects."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.operators.detect import detect
from strophe.plans.generate import generate
from strophe.schemas import PARSED
from strophe.sources import containers, json_dialects, lrc, syllabic, ttml


class Parser(Protocol):
    def __call__(self, text: Column) -> Column: ...


#: Parsers by dialect; raw forms with another envelope share one.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "syllable": syllabic.parse_syllable,
    "lines": syllabic.parse_lines,
    "lrc": lrc.parse,
    "qrc": syllabic.parse_qrc,
    "qrc_full": syllabic.parse_qrc,
    "krc": syllabic.parse_krc,
    "yrc": syllabic.parse_yrc,
    "yrc_full": syllabic.parse_yrc,
    "ttml": ttml.parse,
    "apple_json": ttml.parse,
    "spotify": json_dialects.parse_spotify,
    "musixmatch": json_dialects.parse_musixmatch,
}

#: Decoders of encrypted containers, by dialect.
DECODERS: dict[str, Callable[[Column], Column]] = {"krc": containers.decode_krc, "qrc": containers.decode_qrc}


def register(dialect: str, parser: Parser) -> None:
    """Add a parser: text column to PARSED column."""
    PARSERS[dialect] = parser


def parse(docs: DataFrame, text: str = "text", dialect: str | Column | None = None, out: str = "parsed", dialects: list[str] | None = None) -> DataFrame:
    """``docs`` with ``raw_type`` and the parsed document.

    ``dialect``: one for all rows, a column of names, or None to detect it. The parsers of ``dialects`` (all by
    default) are branches of one CASE, so a row runs its own parser only; TTML, which needs Python, is parsed beside
    the others and sees nulls for all other rows. Rows of unknown dialects are null.
    """
    kind = F.lit(dialect) if isinstance(dialect, str) else detect(F.col(text)) if dialect is None else dialect
    names = [dialect] if isinstance(dialect, str) else dialects or list(PARSERS)
    docs = docs.withColumn("raw_type", kind)
    python = [n for n in names if PARSERS.get(n) is ttml.parse]
    native = [n for n in names if n in PARSERS and n not in python]
    branches = F.lit(None).cast(PARSED)
    for n in reversed(native):
        branches = F.when(F.col("raw_type") == n, PARSERS[n](F.col(text)).cast(PARSED)).otherwise(branches)
    if python:
        docs = docs.withColumn("_xml", ttml.parse(F.when(F.col("raw_type").isin(python), F.col(text))))
        branches = F.when(F.col("raw_type").isin(python), F.col("_xml")).otherwise(branches)
    return docs.withColumn(out, branches).drop("_xml")


def unwrap_apple_json(c: Column) -> Column:
    """The TTML inside a JSON envelope, or the text itself."""
    v = F.try_parse_json(c)
    inside = F.coalesce(*[F.try_variant_get(v, p, "string") for p in ("$.ttml", "$.data[0].attributes.ttml", "$.data.attributes.ttml")])
    return F.coalesce(inside, c)


def convert(docs: DataFrame, to: str, text: str = "text", dialect: str | Column | None = None, out: str = "converted", dialects: list[str] | None = None) -> DataFrame:
    """``docs`` with the text written in another dialect; null where that cannot be."""
    parsed = parse(docs, text, dialect, "_parsed", dialects)
    return parsed.withColumn(out, generate(F.col("_parsed"), to)).drop("_parsed")


def decode(docs: DataFrame, dialect: str, coded: str = "coded", out: str = "text") -> DataFrame:
    """``docs`` with the text of encrypted containers."""
    return docs.withColumn(out, DECODERS[dialect](F.col(coded)))
