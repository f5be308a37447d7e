"""Dialects in JSON: the colour-lyrics document and the macro response with three kinds of lyrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strophe.functions import model
from strophe.functions.text import to_int, trim
from strophe.schemas import LINE, PARSED, SYLLABLE, struct
from strophe.sources import lrc

_SPOTIFY = (
    "struct<lyrics:struct<syncType:string,lines:array<struct<startTimeMs:string,endTimeMs:string,words:string,"
    "syllables:array<struct<startTimeMs:string,endTimeMs:string,numChars:string,charsCount:string>>>>,"
    "provider:string,providerLyricsId:string,providerDisplayName:string,language:string>>"
)
_RICH = "array<struct<ts:double,te:double,l:array<struct<c:string,o:double>>,x:string>>"
# Names of the synchronisation in the document.
_SYNC = {"UNSYNCED": "Unsynced", "LINE_SYNCED": "LineSynced", "SYLLABLE_SYNCED": "SyllableSynced"}


def _int_or_zero(c: Column) -> Column:
    return F.coalesce(to_int(c), F.lit(0))


def _spotify_syllables(line: Column) -> Column:
    """Each syllable takes the next so many characters of the words."""
    sizes = F.transform(line["syllables"], lambda s: _int_or_zero(F.coalesce(s["numChars"], s["charsCount"])))

    def one(s: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, b: a + b)
        text = F.substring(line["words"], before + 1, F.get(sizes, i))
        return F.struct(text.alias("text"), _int_or_zero(s["startTimeMs"]).alias("start_ms"), _int_or_zero(s["endTimeMs"]).alias("end_ms"))

    return F.transform(line["syllables"], one).cast(f"array<{SYLLABLE}>")


def parse_spotify(c: Column) -> Column:
    """Null if the text is no such document. Numbers in place of text are accepted."""
    doc = F.from_json(c, _SPOTIFY)["lyrics"]

    def synced(x: Column) -> Column:
        end = _int_or_zero(x["endTimeMs"])
        plain = model.line(x["words"], _int_or_zero(x["startTimeMs"]), F.when(end != 0, end))
        return F.when(F.coalesce(F.size(x["syllables"]) > 0, F.lit(False)), model.syllable_line(_spotify_syllables(x))).otherwise(plain)

    lines = F.when(doc["syncType"] == "UNSYNCED", F.transform(doc["lines"], lambda x: model.line(x["words"]))).otherwise(F.transform(doc["lines"], synced))
    sync = F.lit("Unknown")
    for name, value in _SYNC.items():
        sync = F.when(doc["syncType"] == name, value).otherwise(sync)
    info = model.spotify_info(doc["provider"], doc["providerLyricsId"], doc["providerDisplayName"], doc["language"])
    return F.when(doc["syncType"].isNotNull() & doc["lines"].isNotNull(), struct(PARSED, lyrics_type="spotify", sync_type=sync, additional_info=info, lines=lines.cast(f"array<{LINE}>")))


def _at(v: Column, *path: str, kind: str = "string") -> Column:
    quoted = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path)
    return F.try_variant_get(v, "$" + quoted, kind)


def parse_musixmatch(c: Column, ignore_syllables: bool = False) -> Column:
    """The first of rich, subtitle and plain lyrics whose call has status 200; null without any."""
    v = F.try_parse_json(c)
    calls = ("message", "body", "macro_calls")

    def ok(call: str) -> Column:
        return F.coalesce(_at(v, *calls, call, "message", "header", "status_code", kind="long") == 200, F.lit(False))

    def text(call: str, *path: str) -> Column:
        return _at(v, *calls, call, "message", "body", *path)

    rich_call, subtitle_call, plain_call = "track.richsync.get", "track.subtitles.get", "track.lyrics.get"
    rich = F.from_json(text(rich_call, "richsync", "richsync_body"), _RICH)
    ms = lambda x: (x * 1000).try_cast("int")

    def rich_line(x: Column) -> Column:
        start = ms(x["ts"])

        def one(s: Column, i: Column) -> Column:
            after = F.get(x["l"], i + 1)["o"]
            end = F.when(after.isNotNull(), start + ms(after)).otherwise(ms(x["te"]))
            return F.struct(s["c"].alias("text"), (start + ms(s["o"])).alias("start_ms"), end.alias("end_ms"))

        return model.syllable_line(F.transform(x["l"], one).cast(f"array<{SYLLABLE}>"))

    def made(sync: str, lines: Column, language: Column | None) -> Column:
        meta = model.metadata(language=F.when(language.isNotNull(), F.array(language))) if language is not None else model.metadata()
        return struct(PARSED, lyrics_type="musixmatch", sync_type=sync, metadata=meta, lines=lines.cast(f"array<{LINE}>"))

    subtitle = text(subtitle_call, "subtitle_list", "0", "subtitle", "subtitle_body")
    plain = text(plain_call, "lyrics", "lyrics_body")
    rich_language = F.coalesce(text(rich_call, "richsync", "richssync_language"), text(rich_call, "richsync", "richsync_language"))
    out = F.when(ok(subtitle_call) & subtitle.isNotNull(), made("LineSynced", lrc.parse_lines(subtitle), text(subtitle_call, "subtitle_list", "0", "subtitle", "subtitle_language")))
    out = out.when(ok(plain_call) & plain.isNotNull(), made("Unsynced", F.transform(F.split(trim(plain), r"\r?\n", -1), lambda x: model.line(x)), None))
    if ignore_syllables:
        return out
    return F.when(ok(rich_call) & rich.isNotNull(), made("SyllableSynced", F.transform(rich, rich_line), rich_language)).otherwise(out)
