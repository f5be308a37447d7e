"""Writing lines back as text: one string for each document, by expressions over its line array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions import model
from strophe.functions.text import timestamp
from strophe.schemas import LEFT, RIGHT

#: A gap after a line that is worth a line of its own, in milliseconds.
HUGE_GAP = 5000


def _rows(parts: Column) -> Column:
    """Rows, each with its line feed; nulls are left out."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.concat(p, F.lit("\n"))), "")


def add_end(end: Column, lines: Column, i: Column, policy: str) -> Column:
    """Whether the end of line ``i`` gets a stamp of its own: never, always, or before a huge gap."""
    if policy == "none":
        return F.lit(False)
    known = F.coalesce(end > 0, F.lit(False))
    if policy == "all":
        return known
    following = model.start_of(F.get(lines, i + 1))
    return known & F.coalesce(following - end > HUGE_GAP, F.lit(True))


def lrc(lines: Column, metadata: Column | None = None, end_times: str = "huge", sub_lines: str = "in_main") -> Column:
    """LRC. ``end_times``: none, huge or all; ``sub_lines``: in_main, or on rows of their own (separate)."""

    def stamped(start: Column, text: Column, end: Column, i: Column) -> Column:
        main = F.when(start.isNotNull(), F.concat(F.lit("["), timestamp(start), F.lit("]"), text))
        stop = F.when(start.isNotNull() & add_end(end, lines, i, end_times), F.concat(F.lit("["), timestamp(end), F.lit("]")))
        return F.array(main, stop)

    def one(x: Column, i: Column) -> Column:
        if sub_lines == "in_main":
            return stamped(model.start_of(x), model.full_text(x), model.end_of(x), i)
        sub = x["sub_line"]
        own = stamped(model.start_of(x), model.any_text(x), model.end_of(x), i)
        return F.concat(own, stamped(model.start_of(sub), model.any_text(sub), model.end_of(sub), i))

    head = F.lit("")
    if metadata is not None:
        tags = [F.when(metadata[f].isNotNull(), F.concat(F.lit(f"[{t}:"), metadata[f], F.lit("]"))) for t, f in (("ti", "title"), ("ar", "artist"), ("al", "album"))]
        head = _rows(F.array(*tags))
    return F.concat(head, F.coalesce(_rows(F.flatten(F.transform(lines, one))), F.lit("")))


def _syllabic(lines: Column, row, sub_row=None) -> Column:
    """Rows of the syllable lines and of the lines under them; plain lines have none."""

    def one(x: Column) -> Column:
        sub = x["sub_line"]
        return F.array(F.when(x["is_syllable"], row(x)), F.when(x["is_syllable"] & F.coalesce(sub["is_syllable"], F.lit(False)), (sub_row or row)(sub)))

    return F.coalesce(_rows(F.flatten(F.transform(lines, one))), F.lit(""))


def _joined(x: Column, one, separator: str = "") -> Column:
    return F.array_join(F.transform(x["syllables"], one), separator)


def _head(x: Column, second: Column) -> Column:
    start = model.start_of(x)
    return F.when(start.isNotNull(), F.format_string("[%d,%d]", start, second)).otherwise("")


def _after(s: Column) -> Column:
    return F.concat(s["text"], F.format_string("(%d,%d)", s["start_ms"], s["end_ms"] - s["start_ms"]))


def qrc(lines: Column) -> Column:
    return _syllabic(lines, lambda x: F.concat(_head(x, model.duration_of(x)), _joined(x, _after)))


def krc(lines: Column, canonical: bool = False) -> Column:
    """KRC; the customary form separates syllables by a mark that parsers take for an empty syllable, the canonical
    form does not."""

    def one(start: Column):
        return lambda s: F.concat(F.format_string("<%d,%d,0>", s["start_ms"] - start, s["end_ms"] - s["start_ms"]), s["text"])

    return _syllabic(lines, lambda x: F.concat(_head(x, model.duration_of(x)), _joined(x, one(model.start_of(x)), "" if canonical else ",0>")))


def yrc(lines: Column) -> Column:
    one = lambda s: F.concat(F.format_string("(%d,%d,0)", s["start_ms"], s["end_ms"] - s["start_ms"]), s["text"])
    return _syllabic(lines, lambda x: F.concat(_head(x, model.duration_of(x)), _joined(x, one)))


def side_code(alignment: Column) -> Column:
    return F.when(alignment == LEFT, 4).when(alignment == RIGHT, 5).otherwise(3)


def syllable(lines: Column) -> Column:
    """The syllable dialect: [3] to [5] by side, three more for background."""
    row = lambda more: lambda x: F.concat(F.format_string("[%d]", side_code(x["alignment"]) + more), _joined(x, _after))
    return _syllabic(lines, row(0), row(3))


def lines_dialect(lines: Column, sub_lines: str = "in_main") -> Column:
    """[start,end]text for lines with both times."""

    def row(x: Column, text: Column) -> Column:
        start, end = model.start_of(x), model.end_of(x)
        return F.when(start.isNotNull() & end.isNotNull(), F.concat(F.format_string("[%d,%d]", start, end), text))

    def one(x: Column) -> Column:
        if sub_lines == "in_main":
            return F.array(row(x, model.full_text(x)))
        return F.array(row(x, model.any_text(x)), row(x["sub_line"], model.any_text(x["sub_line"])))

    return F.coalesce(_rows(F.flatten(F.transform(lines, one))), F.lit(""))


#: Dialects that can be written, by name.
WRITERS = {"lrc": lrc, "qrc": qrc, "krc": krc, "yrc": yrc, "syllable": syllable, "lines": lines_dialect}


def generate(parsed: Column, dialect: str) -> Column:
    """Text of a parsed document in a dialect; null if the dialect cannot be written or nothing would be."""
    if dialect not in WRITERS:
        return F.lit(None).cast("string")
    lines = parsed["lines"]
    out = lrc(lines, parsed["metadata"]) if dialect == "lrc" else WRITERS[dialect](lines)
    return F.when(F.trim(out) != "", out)
