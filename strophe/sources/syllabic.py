"""Dialects with timed syllables: QRC, KRC, YRC and the syllable dialect; and the line dialect with [begin,end].

All are expressions over the lines of a document: one regular expression finds the syllables of a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions import model
from strophe.functions.text import let, to_int, trim
from strophe.operators.detect import LINES_TAG
from strophe.operators.retime import shift_lines
from strophe.schemas import LEFT, LINE, PARSED, RIGHT, SYLLABLE, UNSPECIFIED, struct
from strophe.sources import headers

_LINES = f"array<{LINE}>"
_AFTER = r"(.*?)\((\d+),(\d+)\)"
_ANGLE = r"<(-?\d+),(\d+),\d+>([^<]*)"
_BEFORE = r"\((\d+),(\d+),\d+\)((?:(?!\(\d+,\d+,\d+\)).)*)"


def _found(c: Column, pattern: str, text: int, start: int, length: int, base: Column | None = None) -> Column:
    """Syllables where the groups of a pattern are the text, the start and the duration; numbers out of range end the line."""
    get = lambda g: F.regexp_extract_all(c, F.lit(pattern), F.lit(g))
    rows = F.arrays_zip(get(text).alias("t"), get(start).alias("s"), get(length).alias("d"))

    def one(r: Column) -> Column:
        s, d = r["s"].try_cast("int"), r["d"].try_cast("int")
        s = s if base is None else base + s
        return F.struct(r["t"].alias("text"), s.alias("start_ms"), (s + d).alias("end_ms"))

    return F.transform(rows, one).cast(f"array<{SYLLABLE}>")


def _after_bracket(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^\]]*\]", "")


def _document(kind: str, lines: Column, made: Callable[[Column, Column], Column], info=lambda kept, _: model.general_info(kept), sync: str = "SyllableSynced") -> Column:
    """A document from its text lines; ``made`` makes its lines of those after the header and the header's offset."""

    def whole(attrs: Column, rest: Column) -> Column:
        return struct(
            PARSED,
            lyrics_type=kind,
            sync_type=sync,
            metadata=headers.header_metadata(attrs),
            additional_info=info(headers.kept_attributes(attrs), attrs),
            lines=let(headers.offset(attrs), lambda offset: made(rest, offset)),
        )

    return headers.with_header(lines, whole)


# --- QRC -----------------------------------------------------------------------------------------------------------


def qrc_line(c: Column) -> Column:
    """text(start,duration)...; a line without syllables stays as an empty one."""
    return model.syllable_line(_found(_after_bracket(c), _AFTER, 1, 2, 3))


def qrc_lines(lines: Column, offset: Column) -> Column:
    return shift_lines(F.transform(lines, qrc_line).cast(_LINES), offset)


def parse_qrc(c: Column) -> Column:
    return _document("qrc", headers.text_lines(trim(c)), qrc_lines)


# --- KRC -----------------------------------------------------------------------------------------------------------

_LANGUAGE = "struct<content:array<struct<type:int,lyricContent:array<array<string>>>>>"


def krc_line(c: Column) -> Column:
    """[start,duration]<offset,duration,0>text...; offsets count from the line's start; null without a start."""
    start = to_int(F.regexp_extract(c, r"^\[([^,\]]*)", 1))
    # A separator before the next syllable belongs to neither text.
    body = F.regexp_replace(_after_bracket(c), r",0>(?=<|$)", "")
    return F.when(start.isNotNull(), model.syllable_line(_found(body, _ANGLE, 3, 1, 2, start)))


def krc_text_lines(c: Column) -> Column:
    return F.filter(headers.text_lines(c), lambda x: x.startswith("["))


def krc_lyric_lines(c: Column) -> Column:
    """Without information lines: [ and a digit, at least five bytes."""
    return F.filter(headers.text_lines(c), lambda x: x.rlike(r"^\[\d") & (F.octet_length(x) >= 5))


def krc_translation_raw(c: Column) -> Column:
    """The decoded language tag, or null."""
    coded = F.regexp_extract(c, r"\[language:([^\]]*)\]", 1)
    text = F.when(coded != "", F.try_validate_utf8(F.try_to_binary(coded, F.lit("base64")).cast("string")))
    return F.from_json(text, _LANGUAGE)


def has_krc_translation(c: Column) -> Column:
    return F.coalesce(F.size(krc_translation_raw(c)["content"]) > 0, F.lit(False))


def krc_translations(c: Column) -> Column:
    """First text of each line of the first content of type 1; lines that are null or empty take no place."""
    first = F.try_element_at(F.filter(krc_translation_raw(c)["content"], lambda x: x["type"] == 1), F.lit(1))
    return F.transform(F.filter(first["lyricContent"], lambda x: x.isNotNull() & (F.size(x) > 0)), lambda x: F.get(x, F.lit(0)))


def _translated(lines: Column, texts_: Column) -> Column:
    """Lines with the translation at their place; // stands for none, and the line is a full one all the same."""

    def put(texts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            t = F.get(texts, i)
            entry = F.when((t != "//") & (t != ""), F.create_map(F.lit("zh"), t)).otherwise(F.create_map().cast("map<string,string>"))
            return F.when(i < F.size(texts), model.to_full(x, entry, only_syllables=True)).otherwise(x)

        return F.when(texts.isNull(), lines).otherwise(F.transform(lines, one).cast(_LINES))

    return let(texts_, put)


def krc_lines(lines: Column, offset: Column) -> Column:
    made = F.transform(F.filter(lines, lambda x: x.startswith("[")), krc_line).cast(_LINES)
    return shift_lines(F.filter(made, lambda x: x.isNotNull()), offset)


def parse_krc(c: Column) -> Column:
    info = lambda kept, attrs: model.krc_info(kept, headers.last_value(attrs, "hash"))
    return _document("krc", krc_text_lines(c), lambda rest, offset: _translated(krc_lines(rest, offset), krc_translations(c)), info)


def parse_krc_lines(c: Column) -> Column:
    """Only the lines, with their translations."""
    return _translated(krc_lines(krc_lyric_lines(c), F.lit(None).cast("int")), krc_translations(c))


# --- YRC -----------------------------------------------------------------------------------------------------------

_CREDIT = "struct<t:int,c:array<struct<tx:string>>>"
# Fixed value: the credit that names the writers.
WRITERS = "作词"


def yrc_line(c: Column) -> Column:
    """[start,duration](start,duration,0)text...; times are those of the track."""
    return model.syllable_line(_found(_after_bracket(c), _BEFORE, 3, 1, 2))


def parse_yrc(c: Column) -> Column:
    """Credit lines (JSON) become plain timed lines in their place; with them the document is mixed-synced."""
    rows = F.filter(headers.text_lines(c), lambda x: trim(x) != "")
    kinds = F.transform(rows, lambda x: F.struct(x.alias("x"), F.when(x.startswith("{"), F.from_json(x, _CREDIT)).alias("credit")))
    return let(kinds, _yrc)


def _yrc(kinds: Column) -> Column:
    credits = F.filter(F.transform(kinds, lambda k: k["credit"]), lambda k: k["t"].isNotNull())
    names = F.try_element_at(F.filter(credits, lambda k: F.get(k["c"], F.lit(0))["tx"].startswith(WRITERS)), F.lit(1))["c"]
    writers = F.filter(F.transform(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), lambda x: x["tx"]), lambda t: t != "/")

    def one(k: Column) -> Column:
        text = F.array_join(F.transform(k["credit"]["c"], lambda x: x["tx"]), "")
        return F.when(k["credit"]["t"].isNotNull(), model.line(text, k["credit"]["t"])).when(k["x"].rlike(r"^\[\d+,\d+\]"), yrc_line(k["x"]))

    lines = F.filter(F.transform(kinds, one).cast(_LINES), lambda x: x.isNotNull())
    sync = F.when(F.size(credits) > 0, "MixedSynced").otherwise("SyllableSynced")
    return struct(PARSED, lyrics_type="yrc", sync_type=sync, writers=writers, lines=lines)


def parse_yrc_lines(c: Column) -> Column:
    """Only the lines; credits at the end are left out."""
    made = parse_yrc(c)["lines"]
    last = F.array_max(F.transform(made, lambda x, i: F.when(x["is_syllable"], i)))
    return F.filter(made, lambda _, i: i <= F.coalesce(last, F.lit(-1)))


# --- the syllable dialect ------------------------------------------------------------------------------------------


def syllable_line(c: Column) -> Column:
    """(line, flag) of [p]text(start,duration)...: p says the side, and from 6 on that the line is in the background."""
    p = to_int(F.regexp_extract(c, r"^\[([0-9]+)\]", 1))
    side = F.when(p % 3 == 1, LEFT).when(p % 3 == 2, RIGHT).otherwise(UNSPECIFIED)
    flag = F.when(p >= 6, True).when(p >= 3, False)
    syllables = _found(_after_bracket(F.regexp_replace(c, f"^{headers.BOM}+", "")), _AFTER, 1, 2, 3)
    return F.struct(model.syllable_line(syllables, F.coalesce(side, F.lit(UNSPECIFIED))).alias("line"), flag.alias("back"))


def is_bracketed(x: Column) -> Column:
    """Text from an opening to a closing bracket, of either width."""
    return model.any_text(x).rlike(r"(?s)^[(（].*[)）]$|^[(（][)）]$")


def merge_background(flagged: Column) -> Column:
    """Lines with background lines put under them.

    First every flagged line goes under the kept line before it (the last one stays); then a bracketed line without a
    flag goes under the one before it if neither neighbour is in the background; after such a merge the next line is
    passed over. Both are folds within the document.
    """
    kind = f"array<struct<line:{LINE},back:boolean>>"
    none = F.array().cast(kind)

    def put(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        under = F.struct(last["line"].withField("sub_line", model.as_sub_line(x["line"])).alias("line"), last["back"].alias("back"))
        return F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(under)).cast(kind)

    def first(out: Column, x: Column) -> Column:
        return F.when(F.coalesce(x["back"], F.lit(False)) & (F.size(out) > 0), put(out, x)).otherwise(F.concat(out, F.array(x)).cast(kind))

    marked = F.aggregate(flagged.cast(kind), none, first)
    plain = lambda x: F.when(x["back"].isNull(), ~is_bracketed(x["line"])).otherwise(~x["back"])
    state = F.struct(none.alias("out"), F.lit(False).alias("skip"))

    def second(s: Column, p: Column) -> Column:
        x, after, out = p["x"], p["after"], s["out"]
        merge = (
            ~s["skip"] & x["back"].isNull() & is_bracketed(x["line"]) & x["line"]["sub_line"].isNull() & (F.size(out) > 0)
            & F.coalesce(plain(F.try_element_at(out, F.lit(-1))), F.lit(False)) & F.coalesce(plain(after), F.lit(True))
        )
        return F.struct(F.when(merge, put(out, x)).otherwise(F.concat(out, F.array(x)).cast(kind)).alias("out"), F.coalesce(merge, F.lit(False)).alias("skip"))

    pairs = F.transform(marked, lambda x, i: F.struct(x.alias("x"), F.get(marked, i + 1).alias("after")))
    return F.transform(F.aggregate(pairs, state, second, lambda s: s["out"]), lambda x: x["line"])


def syllable_lines(lines: Column, offset: Column) -> Column:
    made = F.filter(F.transform(lines, syllable_line), lambda x: F.size(x["line"]["syllables"]) > 0)
    return shift_lines(merge_background(made), offset)


def parse_syllable(c: Column) -> Column:
    return _document("syllable", headers.text_lines(trim(c)), syllable_lines)


# --- the line dialect ----------------------------------------------------------------------------------------------


def lines_line(c: Column) -> Column:
    """[begin,end]text, or null."""
    begin, end = (to_int(F.regexp_extract(c, r"^\[([^,\]]*),([^\]]*)\]", i)) for i in (1, 2))
    return F.when(begin.isNotNull() & end.isNotNull(), model.line(trim(_after_bracket(c)), begin, end))


def parse_lines(c: Column) -> Column:
    lines = headers.text_lines(trim(F.replace(c, F.lit(LINES_TAG), F.lit(""))))
    return _document("lines", lines, lambda rest, offset: shift_lines(F.filter(F.transform(rest, lines_line).cast(_LINES), lambda x: x.isNotNull()), offset), sync="LineSynced")
