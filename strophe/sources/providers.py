"""Live catalogues: requests as columns, one Arrow UDF that sends them, and a searcher for each provider.

A searcher turns query texts into requests; ``search`` sends them and reads the answers with the provider's adapter, so
the rows are those of ``catalogs.candidates``. Sending is the only part that is not an expression. A request that fails
in any way, or is answered by a status of 400 or more, has a null answer. Each task sends ``PARALLEL`` requests at once;
spread the queries over as many partitions as the provider bears. Tokens are given by the caller and never stored.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strophe.sources import catalogs

REQUEST = "struct<method:string,url:string,headers:map<string,string>,body:string>"
PARALLEL = 8
TIMEOUT = 10.0
AGENT = "strophe/0.2"

# Addresses of the providers and the headers they ask for.
MUSIXMATCH = "https://apic-desktop.musixmatch.com/ws/1.1"
MUSIXMATCH_APP = "app_id=web-desktop-app-v1.0&usertoken="
MUSIXMATCH_HEADERS = {"Authority": "apic-desktop.musixmatch.com", "Cookie": "AWSELBCORS=0; AWSELB=0"}
NETEASE_HEADERS = {"Referer": "https://music.163.com/", "Cookie": "os=pc;appver=2.9.7;channel=netease;", "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64)"}
LRCLIB = "https://lrclib.net/api"
QQ = "https://u.y.qq.com/cgi-bin/musicu.fcg"


def encoded(c: Column) -> Column:
    """Percent encoding; a space is %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def _url(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def request(url: Column, headers: dict[str, str | Column] | None = None, body: Column | None = None, form: bool = False) -> Column:
    """A request: GET, or POST if it has a body (JSON, or a form's fields)."""
    own = dict(headers or {})
    if body is not None:
        own["Content-Type"] = "application/x-www-form-urlencoded" if form else "application/json"
    pairs = [x if isinstance(x, Column) else F.lit(x) for pair in own.items() for x in pair]
    kept = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    method = "GET" if body is None else "POST"
    return F.struct(F.lit(method).alias("method"), url.alias("url"), kept.alias("headers"), (body if body is not None else F.lit(None).cast("string")).alias("body")).cast(REQUEST)


def form_body(fields: dict[str, Column]) -> Column:
    """Fields of a form."""
    return F.array_join(F.array(*[_url(f"{k}=", F.url_encode(v)) for k, v in fields.items()]), "&")


def send(r: dict | None) -> str | None:
    """The text of an answer, or None."""
    if r is None or r["url"] is None:
        return None
    data = None if r["body"] is None else r["body"].encode()
    headers = {"User-Agent": AGENT} | dict(r["headers"] or [])
    try:
        with urllib.request.urlopen(urllib.request.Request(r["url"], data, headers, method=r["method"]), timeout=TIMEOUT) as answer:
            return answer.read().decode()
    except (OSError, ValueError):  # no connection, a status that is an error, a bad address, no UTF-8
        return None


def _first(rs: list[dict] | None) -> str | None:
    return next((x for r in rs or [] if (x := send(r)) and x.strip() not in ("[]", "{}", "null")), None)


def _sent(c: Column, one: Callable) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(PARALLEL) as pool:
            for batch in batches:
                yield pa.array(list(pool.map(one, batch.to_pylist())), pa.string())

    return F.arrow_udf(run, StringType())(c)


def fetch(c: Column) -> Column:
    """Answers of requests."""
    return _sent(c, send)


def fetch_first(c: Column) -> Column:
    """Of several requests in order, the first answer that holds anything; later ones are not sent."""
    return _sent(c, _first)


# --- requests ------------------------------------------------------------------------------------------------------


def apple_music(query: Column, token: str = "", storefront: str = "us", language: str = "en-US") -> Column:
    headers = {"Authorization": f"Bearer {token}", "Origin": "https://music.apple.com", "Referer": "https://music.apple.com/", "Accept": "application/json"}
    return request(_url(f"https://amp-api.music.apple.com/v1/catalog/{storefront}/search?term=", encoded(query), f"&types=songs&limit=10&l={language}"), headers)


def kugou(query: Column) -> Column:
    return request(_url("http://mobilecdn.kugou.com/api/v3/search/song?format=json&keyword=", encoded(query), "&page=1&pagesize=20&showtype=1"))


def lrclib(query: Column, artist: Column | None = None, album: Column | None = None, duration_ms: Column | None = None, exact: bool = False) -> Column:
    """Search by title and what else is known; ``exact`` asks for the one track."""
    more = [F.coalesce(_url(f"&{name}=", value), F.lit("")) for name, value in (("artist_name", artist), ("album_name", album)) if value is not None for value in [encoded(value)]]
    if duration_ms is not None:
        more.append(F.coalesce(_url("&duration=", (duration_ms / 1000).cast("string")), F.lit("")))
    return request(_url(f"{LRCLIB}/{'get' if exact else 'search'}?track_name=", encoded(query), *more))


def lrclib_track(title: Column, artist: Column, album: Column, duration_ms: Column) -> Column:
    """Requests for a track in their order: the one track, a search by its fields, a search by its text."""
    name = F.coalesce(artist, F.lit(""))
    free = F.trim(F.replace(F.concat(title, F.lit(" "), name), F.lit(" - "), F.lit(" ")))
    return F.array(lrclib(title, name, album, duration_ms, exact=True), lrclib(title, name, album, duration_ms), lrclib(free))


def lrclib_by_id(id_: Column) -> Column:
    return request(_url(f"{LRCLIB}/get/", id_.cast("string")))


def musixmatch(query: Column, token: str = "") -> Column:
    q = catalogs.musixmatch_query(query)
    return request(_url(f"{MUSIXMATCH}/matcher.track.get?{MUSIXMATCH_APP}{token}&q_track=", encoded(q["track"]), "&q_artist=", encoded(q["artist"])), MUSIXMATCH_HEADERS)


def musixmatch_token() -> Column:
    return request(_url(f"{MUSIXMATCH}/token.get?app_id=web-desktop-app-v1.0"), MUSIXMATCH_HEADERS)


def musixmatch_lyrics(track_id: Column, token: str, synced: bool = False) -> Column:
    call, end = ("track.subtitle.get", "&subtitle_format=lrc") if synced else ("track.lyrics.get", "")
    return request(_url(f"{MUSIXMATCH}/{call}?{MUSIXMATCH_APP}{token}&track_id=", track_id.cast("string"), end), MUSIXMATCH_HEADERS)


def netease(query: Column) -> Column:
    return request(_url("https://music.163.com/api/search/get?s=", encoded(query), "&type=1&limit=10&offset=0"), NETEASE_HEADERS)


def netease_lyrics(song_id: Column) -> Column:
    return request(_url("https://music.163.com/api/song/lyric?id=", song_id.cast("string"), "&lv=1&kv=1&tv=-1"), NETEASE_HEADERS)


def netease_pair(answer: Column) -> Column:
    """(lyric, translated) of a lyric answer."""
    v = F.from_json(answer, "struct<lrc:struct<lyric:string>,tlyric:struct<lyric:string>>")
    return F.struct(v["lrc"]["lyric"].alias("lyric"), v["tlyric"]["lyric"].alias("translated"))


def _qq(module: str, method: str, param: Column) -> Column:
    comm = F.struct(F.lit(11).alias("ct"), F.lit("1003006").alias("cv"), F.lit("1003006").alias("v"), F.lit("qqmusiclight").alias("tmeAppID"), F.lit("0").alias("uid"))
    body = F.struct(comm.alias("comm"), F.struct(F.lit(method).alias("method"), F.lit(module).alias("module"), param.alias("param")).alias("req_1"))
    return request(F.lit(QQ), {}, F.to_json(body))


def qq_music(query: Column) -> Column:
    param = F.struct(F.expr("CAST(uuid() AS STRING)").alias("search_id"), query.alias("query"), F.lit(0).alias("search_type"), F.lit(20).alias("num_per_page"), F.lit(1).alias("page_num"))
    return _qq("music.search.SearchCgiService", "DoSearchForQQMusicLite", param)


def qq_lyrics(mid: Column, id_: Column, title: Column, artist: Column, album: Column, duration_ms: Column) -> Column:
    coded = lambda c: F.base64(c.cast("binary"))
    flags = [F.lit(1).alias(n) for n in ("crypt", "qrc", "roma", "trans")]
    names = [mid.alias("songMID"), F.coalesce(id_, F.lit(0)).alias("songID"), coded(title).alias("songName"), coded(artist).alias("singerName"), coded(album).alias("albumName")]
    return _qq("music.musichallSong.PlayLyricInfo", "GetPlayLyricInfo", F.struct(*names, F.floor(F.coalesce(duration_ms, F.lit(0)) / 1000).alias("interval"), *flags))


def soda_music(query: Column) -> Column:
    return request(_url("https://api.qishui.com/luna/pc/search/track?aid=386088&q=", encoded(query), "&cursor=&search_method=input"), {"Referer": "https://api.qishui.com/"})


def spotify(query: Column, token: str = "") -> Column:
    return request(_url("https://api.spotify.com/v1/search?q=", encoded(query), "&type=track&limit=10&market=from_token"), {"Authorization": f"Bearer {token}"})


def kugou_lyrics(query: Column, hash_: Column, duration_ms: Column) -> Column:
    return request(_url("http://lyrics.kugou.com/search?ver=1&man=yes&client=pc&keyword=", encoded(query), "&hash=", hash_, "&timelength=", duration_ms.cast("string")))


def kugou_download(answer: Column) -> Column:
    """The download of the first candidate of a lyric search; null without one."""
    c = F.get(F.from_json(answer, "struct<candidates:array<struct<id:string,accesskey:string>>>")["candidates"], F.lit(0))
    return F.when(c.isNotNull(), request(_url("http://lyrics.kugou.com/download?ver=1&client=pc&id=", c["id"], "&accesskey=", c["accesskey"], "&fmt=lrc&charset=utf8")))


# --- searchers -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Searcher:
    """A provider: its name, the name to show, and the request of a query text (further options by name)."""

    name: str
    display_name: str
    request: Callable[..., Column]


SEARCHERS = {
    s.name: s
    for s in (
        Searcher("apple_music", "Apple Music", apple_music), Searcher("kugou", "Kugou Music", kugou), Searcher("lrclib", "LRCLIB", lrclib),
        Searcher("musixmatch", "Musixmatch", musixmatch), Searcher("netease", "Netease Cloud Music", netease), Searcher("qq_music", "QQ Music", qq_music),
        Searcher("soda_music", "Soda Music", soda_music), Searcher("spotify", "Spotify", spotify),
    )
}


def search(asked: DataFrame, provider: str, query: str = "query", transport: Callable[[Column], Column] = fetch, **options) -> DataFrame:
    """Candidates of a provider for a column of query texts, each asked once; ``transport`` turns requests into answers."""
    texts = asked.select(F.col(query).alias("query")).filter(F.col("query").isNotNull()).distinct()
    answers = texts.select("query", SEARCHERS[provider].request(F.col("query"), **options).alias("r")).select("query", transport(F.col("r")).alias("body"))
    return catalogs.candidates(answers, provider)
