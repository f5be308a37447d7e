"""Cleaning of parsed lines: expressions over the line array of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions import model
from strophe.functions.text import EXPLICIT, is_punctuation
from strophe.schemas import LINE, SYLLABLE

# How lines that credit writers begin.
CREDITS = ("作词", "作曲", "编曲", "词：", "曲：")


def _plain(x: Column) -> Column:
    return ~x["is_syllable"] & ~x["is_full"]


def drop_leading_blank(lines: Column) -> Column:
    """Without the plain lines at the beginning that have neither text nor time."""
    blank = F.transform(lines, lambda x: _plain(x) & (x["text"] == "") & x["start_ms"].isNull())
    return F.filter(lines, lambda _, i: i >= _first_false(blank))


def _first_false(flags: Column) -> Column:
    at = F.array_position(flags, F.lit(False))
    return F.when(at == 0, F.size(flags)).otherwise(at - 1)


def trim_blank_edges(lines: Column) -> Column:
    """Without the empty plain lines at both ends."""
    blank = F.transform(lines, lambda x: _plain(x) & (x["text"] == ""))
    first, last = _first_false(blank), F.size(lines) - _first_false(F.reverse(blank))
    return F.filter(lines, lambda _, i: (i >= first) & (i < last))


def strip_explicit(lines: Column) -> Column:
    """Without explicit markers at the beginning of lines that have a text of their own."""

    def one(x: Column) -> Column:
        t = F.regexp_replace(x["text"], rf"(?U)^(?:{EXPLICIT[0]})+\s*", "")
        t = F.regexp_replace(t, r"(?U)^(?:\[E\])+\s*", "")
        return x.withField("text", F.when(x["is_syllable"], x["text"]).otherwise(t))

    return F.transform(lines, one)


def drop_info(lines: Column, prefixes: tuple[str, ...] = CREDITS) -> Column:
    """Without plain lines that credit someone and without empty ones with a time."""

    def info(x: Column) -> Column:
        credit = F.lit(False)
        for p in prefixes:
            credit = credit | x["text"].startswith(p)
        return _plain(x) & (credit | (x["text"] == "") & x["start_ms"].isNotNull())

    return F.filter(lines, lambda x: ~F.coalesce(info(x), F.lit(False)))


def to_line_synced(lines: Column) -> Column:
    """Syllable lines as lines: their text, first start and last end; all else stays."""

    def one(x: Column) -> Column:
        new = x.withField("text", model.any_text(x)).withField("start_ms", model.start_of(x)).withField("end_ms", model.end_of(x))
        new = new.withField("syllables", F.lit(None).cast(f"array<{SYLLABLE}>")).withField("is_syllable", F.lit(False))
        return F.when(x["is_syllable"], new.cast(LINE)).otherwise(x)

    return F.transform(lines, one)


def tidy_syllables(syllables: Column) -> Column:
    """No space at the end of the last syllable; marks of one byte that stand alone join the syllable before them."""
    n = F.size(syllables)
    ended = F.transform(syllables, lambda s, i: F.when((i == n - 1) & s["text"].endswith(" "), s.withField("text", F.regexp_replace(s["text"], r"(?U)\s+$", ""))).otherwise(s))
    kind = f"array<{SYLLABLE}>"

    def merge(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        alone = (F.octet_length(s["text"]) == 1) & is_punctuation(s["text"]) & (F.size(out) > 0)
        longer = last.withField("text", F.concat(last["text"], s["text"])).withField("end_ms", s["end_ms"])
        return F.when(alone, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer)).cast(kind)).otherwise(F.concat(out, F.array(s)).cast(kind))

    return F.aggregate(ended.cast(kind), F.array().cast(kind), merge)


def tidy_yrc(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.when(x["is_syllable"], x.withField("syllables", tidy_syllables(x["syllables"])).cast(LINE)).otherwise(x))
