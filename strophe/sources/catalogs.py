"""Candidates from captured answers of eight catalogues: JSON in, rows in the catalogue form out.

An adapter reads the body of an answer; ``providers`` sends the requests. All give: provider, query, cand_no, id,
numeric_id, title, artists, album, album_artists, duration_ms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.text import trim
from strophe.sources.containers import decode_qrc

_NAMES = "array<struct<name:string>>"
# Schemas of the answers, cut to what is read.
SCHEMAS = {
    "apple_music": "struct<results:struct<songs:struct<data:array<struct<id:string,attributes:struct<name:string,artistName:string,albumName:string,durationInMillis:int>>>>>>",
    "kugou": "struct<data:struct<info:array<struct<hash:string,songname:string,singername:string,album_name:string,duration:int>>>>",
    "lrclib": "array<struct<id:long,trackName:string,artistName:string,albumName:string,duration:double>>",
    "musixmatch": "struct<message:struct<body:struct<track:struct<track_id:long,track_name:string,artist_name:string,album_name:string,track_length:int>>,header:struct<status_code:int,confidence:int>>>",
    "netease": f"struct<result:struct<songs:array<struct<id:long,name:string,artists:{_NAMES},album:struct<name:string>,duration:int>>>>",
    "qq_music": f"struct<code:int,req_1:struct<code:int,data:struct<body:struct<song:struct<list:array<struct<id:long,mid:string,title:string,singer:{_NAMES},album:struct<title:string>,interval:int>>>>>>>",
    "soda_music": f"struct<result_groups:array<struct<data:array<struct<entity:struct<track:struct<id:string,name:string,artists:{_NAMES},album:struct<name:string>,duration:int>>>>>>>",
    "spotify": f"struct<tracks:struct<items:array<struct<id:string,name:string,artists:{_NAMES},album:struct<name:string,artists:{_NAMES}>,duration_ms:int>>>>",
}
# Bounds of a provider's own confidence, with the value of the level.
CONFIDENCE = [(1000, 100), (950, 99), (900, 95), (750, 90), (600, 70), (400, 30), (200, 10)]


def split_names(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(c, pattern), lambda x: trim(x)), lambda x: x != "")


def confidence_value(c: Column) -> Column:
    out = F.lit(-1)
    for bound, value in reversed(CONFIDENCE):
        out = F.when(c >= bound, value).otherwise(out)
    return out


def _names(c: Column) -> Column:
    return F.transform(c, lambda x: x["name"])


def _candidate(id_: Column, title: Column, artists: Column, album: Column, duration: Column, numeric: Column | None = None, album_artists: Column | None = None) -> Column:
    return F.struct(
        id_.cast("string").alias("id"),
        (numeric if numeric is not None else F.lit(None)).cast("long").alias("numeric_id"),
        title.alias("title"),
        artists.alias("artists"),
        album.alias("album"),
        (album_artists if album_artists is not None else F.lit(None)).cast("array<string>").alias("album_artists"),
        duration.cast("int").alias("duration_ms"),
    )


def apple_music(v: Column) -> Column:
    def one(x: Column) -> Column:
        a = x["attributes"]
        return _candidate(x["id"], a["name"], F.array(a["artistName"]), a["albumName"], a["durationInMillis"])

    return F.transform(v["results"]["songs"]["data"], one)


def kugou(v: Column) -> Column:
    return F.transform(v["data"]["info"], lambda x: _candidate(x["hash"], x["songname"], split_names(x["singername"], "[,、/]"), x["album_name"], x["duration"] * 1000))


def lrclib(v: Column) -> Column:
    return F.transform(v, lambda x: _candidate(x["id"], x["trackName"], split_names(x["artistName"], r", | & | feat\. | ft\. "), x["albumName"], x["duration"] * 1000, x["id"]))


def musixmatch(v: Column) -> Column:
    m = v["message"]
    t = m["body"]["track"]
    one = _candidate(t["track_id"], t["track_name"], split_names(t["artist_name"], r" feat\. | & "), t["album_name"], t["track_length"] * 1000, t["track_id"])
    return F.when((m["header"]["status_code"] == 200) & t["track_id"].isNotNull(), F.array(one))


def netease(v: Column) -> Column:
    return F.transform(v["result"]["songs"], lambda x: _candidate(x["id"], x["name"], _names(x["artists"]), x["album"]["name"], x["duration"], x["id"]))


def qq_music(v: Column) -> Column:
    ok = (F.coalesce(v["code"], F.lit(0)) == 0) & (F.coalesce(v["req_1"]["code"], F.lit(0)) == 0)
    return F.when(ok, F.transform(v["req_1"]["data"]["body"]["song"]["list"], lambda x: _candidate(x["mid"], x["title"], _names(x["singer"]), x["album"]["title"], x["interval"] * 1000, x["id"])))


def soda_music(v: Column) -> Column:
    def one(x: Column) -> Column:
        t = x["entity"]["track"]
        return _candidate(t["id"], t["name"], _names(t["artists"]), t["album"]["name"], t["duration"])

    return F.transform(F.filter(F.get(v["result_groups"], F.lit(0))["data"], lambda x: x["entity"]["track"].isNotNull()), one)


def spotify(v: Column) -> Column:
    items = F.filter(v["tracks"]["items"], lambda x: x["album"].isNotNull())
    return F.transform(items, lambda x: _candidate(x["id"], x["name"], _names(x["artists"]), x["album"]["name"], x["duration_ms"], album_artists=_names(x["album"]["artists"])))


ADAPTERS: dict[str, Callable[[Column], Column]] = {
    "apple_music": apple_music, "kugou": kugou, "lrclib": lrclib, "musixmatch": musixmatch,
    "netease": netease, "qq_music": qq_music, "soda_music": soda_music, "spotify": spotify,
}


def candidates(answers: DataFrame, provider: str, body: str = "body", query: str = "query") -> DataFrame:
    """Candidates of a provider's answers; bodies that are no such answer have none."""
    found = ADAPTERS[provider](F.from_json(F.col(body), SCHEMAS[provider]))
    rows = answers.select(F.col(query).alias("query"), F.posexplode(found).alias("cand_no", "c"))
    return rows.select(F.lit(provider).alias("provider"), "query", "cand_no", "c.*")


def joined_artists(artists: Column) -> Column:
    return F.array_join(artists, ", ")


def musixmatch_query(text: Column) -> Column:
    """(artist, track) of a query: around the first " - ", else the last word is the artist."""
    dashed = text.contains(" - ")
    words = F.split(trim(text), r"\s+")
    artist = F.when(dashed, trim(F.substring_index(text, " - ", 1))).when(F.size(words) > 1, F.element_at(words, -1)).otherwise("")
    track = F.when(dashed, trim(F.regexp_replace(text, r"^.*? - ", ""))).when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")).otherwise(trim(text))
    return F.struct(artist.alias("artist"), track.alias("track"))


def lrclib_url(track: Column, artist: Column) -> Column:
    return F.concat(F.lit("https://lrclib.net/api/search?track_name="), F.url_encode(track), F.lit("&artist_name="), F.url_encode(artist))


def kugou_lyric(content: Column) -> Column:
    """Text of a downloaded lyric: base64 of UTF-8, or null."""
    return F.try_validate_utf8(F.try_to_binary(content, F.lit("base64")).cast("string"))


def qq_lyric(lyric: Column, qrc_t: Column, lrc_t: Column) -> Column:
    """A lyric decoded where its type flag says it is encrypted; others, empty ones too, are null."""
    flag = F.coalesce(F.nullif(qrc_t, F.lit(0)), lrc_t)
    coded = (F.coalesce(flag, F.lit(0)) != 0) & (lyric != "")
    return F.when(coded, decode_qrc(F.when(coded, lyric)))  # a UDF gets every row, so the others are null to it
