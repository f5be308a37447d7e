"""Dialect detection: an ordered cascade over the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions.text import let, trim

# The tags that name a dialect inside a text.
SYLLABLE_TAG = "[type:LyricifySyllable]"
LINES_TAG = "[type:LyricifyLines]"


def has_syllable_pattern(c: Column) -> Column:
    """One of the first five lines begins with [ and holds ]( and a comma."""
    return F.exists(F.slice(F.split(c, r"\r?\n", 6), 1, 5), lambda x: x.startswith("[") & x.contains("](") & x.contains(","))


def has_lines_pattern(c: Column) -> Column:
    """The text begins with [n,n] and holds a word with (n,n)."""
    return c.rlike(r"(?U)^\[\d+,\d+\]") & c.rlike(r"(?U)\w\(\d+,\d+\)")


def is_lrc(c: Column) -> Column:
    t = trim(c)
    return t.contains("[") & t.contains("]") & t.contains(":") & ~t.contains(",0>") & ~t.contains("],(")


def detect(c: Column) -> Column:
    """Name of the dialect; the order of the tests decides between those that fit."""
    return let(trim(c), _detect)


def _detect(t: Column) -> Column:
    json = t.startswith("{") & t.contains('"')
    return (
        F.when(json & (t.contains("colorLyrics") | t.contains("lyrics") & t.contains("syncType")), "spotify")
        .when(json & t.contains("message") & t.contains("macro_calls"), "musixmatch")
        .when(t.contains("<tt ") & t.contains("xmlns"), "ttml")
        .when(t.contains(SYLLABLE_TAG) | has_syllable_pattern(t), "syllable")
        .when(t.contains(LINES_TAG) | has_lines_pattern(t), "lines")
        .when(t.contains("],(") & t.contains(",0)"), "yrc")
        .when(t.contains(",0>"), "krc")
        .when(t.rlike(r"(?U)\(\d+,\d+\)"), "qrc")
        .when(t.contains("[") & t.contains("]") & t.contains(":"), "lrc")
        .otherwise("unknown")
    )


def detect_strict(c: Column) -> Column:
    """Like ``detect``, but by the grammar of whole lines, so the syllabic dialects are told apart."""
    return let(trim(c), _detect_strict)


def _detect_strict(t: Column) -> Column:
    by_line = (
        F.when(t.rlike(r"(?m)^\[\d+,\d+\]\(\d+,\d+,\d+\)"), "yrc")
        .when(t.rlike(r"(?m)^\[\d+,\d+\]<\d+,\d+,\d+>"), "krc")
        .when(t.rlike(r"(?m)^\[\d+,\d+\].*\(\d+,\d+\)\s*$"), "qrc")
        .when(t.rlike(r"(?m)^\[\d\][^\n]*\(\d+,\d+\)"), "syllable")
        .when(t.rlike(r"(?m)^\[\d+,\d+\]"), "lines")
    )
    return let(_detect(t), lambda found: F.when(found.isin("syllable", "lines", "yrc", "krc", "qrc", "lrc", "unknown") & ~t.contains(SYLLABLE_TAG) & ~t.contains(LINES_TAG), F.coalesce(by_line, found)).otherwise(found))
