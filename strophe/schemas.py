"""Canonical frames of timed text.

A document is one row; its lines are an array column of ``LINE`` structs, so parsing, cleaning and writing are
expressions inside one row and need no shuffle. ``explode_lines`` gives the relational form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYLLABLE = "struct<text:string,start_ms:int,end_ms:int>"
_CORE = f"is_syllable:boolean,is_full:boolean,text:string,start_ms:int,end_ms:int,alignment:string,syllables:array<{SYLLABLE}>"
_TAIL = "translations:map<string,string>,pronunciation:string"
#: A line under another one (background voice) has no further lines under it.
SUB_LINE = f"struct<{_CORE},{_TAIL}>"
LINE = f"struct<{_CORE},sub_line:{SUB_LINE},{_TAIL}>"
METADATA = (
    "struct<title:string,artist:string,album:string,album_artist:string,duration_ms:int,isrc:string,language:array<string>,"
    "artists:array<string>,album_artists:array<string>,spotify_id:string>"
)
ATTRIBUTES = "array<struct<key:string,value:string>>"
ADDITIONAL = f"struct<type:string,attributes:{ATTRIBUTES},hash:string,provider:string,provider_lyrics_id:string,provider_display_name:string,lyrics_language:string>"
#: What a parser makes of one document.
PARSED = f"struct<lyrics_type:string,sync_type:string,writers:array<string>,metadata:{METADATA},additional_info:{ADDITIONAL},lines:array<{LINE}>>"

UNSPECIFIED, LEFT, RIGHT = "Unspecified", "Left", "Right"
DIALECTS = ("unknown", "syllable", "lines", "lrc", "qrc", "krc", "yrc", "ttml", "spotify", "musixmatch")
SYNC = ("Unknown", "SyllableSynced", "LineSynced", "MixedSynced", "Unsynced")


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def struct(kind: str, **values: Column | str | int | bool | None) -> Column:
    """A struct of the given type; fields that are not named are null."""
    body = kind.removeprefix("struct<")[:-1]
    names, depth, start, parts = [], 0, 0, []
    for i, c in enumerate(body + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(body[start:i])
            start = i + 1
    for p in parts:
        name, _, t = p.partition(":")
        v = values.get(name)
        names.append((v if isinstance(v, Column) else F.lit(v)).cast(t).alias(name))
    if unknown := set(values) - {p.partition(":")[0] for p in parts}:
        raise ValueError(f"no such fields: {unknown}")
    return F.struct(*names)


def explode_lines(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """One row for each line, with ``line_no`` from 0; documents without lines have none."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c != lines]
    return docs.select(*keep, F.posexplode(lines).alias("line_no", "_line")).select(*keep, "line_no", "_line.*")
