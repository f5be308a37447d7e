"""Queries over documents written for the purpose: the forms that the driver's tables do not give.

Each document is made from a row of a table by a template; what is expected of it is told in DuckDB SQL by literals
and the row's own values, never by the engine's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.catalogue import FORM, query, table
from strophe.functions import match, model, text
from strophe.operators import clean, detect
from strophe.plans import convert, generate
from strophe.schemas import LINE, SYLLABLE, explode_lines
from strophe.sources import catalogs, containers, json_dialects, lrc, providers, syllabic, ttml

_LINES = f"array<{LINE}>"


def _parts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")


def _doc(template: str) -> Column:
    """A template with @column@ in it."""
    bits = re.split(r"@(\w+)@", template)
    return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(bits)])


def _cases(templates: list[str]) -> Column:
    """The template of the part's key, in turn."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(templates):
        out = F.when(F.col("p_partkey") % len(templates) == i, _doc(t)).otherwise(out)
    return out


def _expected(names: str, rows: list[tuple[str, str]]) -> str:
    """SQL of the rows (condition, values) over the parts."""
    cols, out = names.split(), []
    for condition, values in rows:
        parts = [v.strip() for v in values.split(" | ")]
        if len(parts) != len(cols):
            raise ValueError(f"{len(parts)} values for {len(cols)} columns: {values}")
        out.append("SELECT p_partkey, " + ", ".join(f"{v} AS {c}" for v, c in zip(parts, cols, strict=True)) + f" FROM part WHERE {condition}")
    return "\nUNION ALL ".join(out)


def _one(c: Column, start: Column | int, end: Column | int) -> Column:
    """One syllable."""
    at = [x if isinstance(x, Column) else F.lit(x) for x in (start, end)]
    return F.array(F.struct(c.alias("text"), at[0].cast("int").alias("start_ms"), at[1].cast("int").alias("end_ms"))).cast(f"array<{SYLLABLE}>")


# --- lines, groups, metadata ---------------------------------------------------------------------------------------


@query(
    _expected(
        "own_text any_text start_ms end_ms duration_ms full_text alignment is_syllable",
        [
            ("p_partkey % 3 = 0", "'' | p_name || ' ' | 100 | greatest(200 + p_size, 100 + p_size * 10) | greatest(200 + p_size, 100 + p_size * 10) - 100 | '(' || p_brand || ') ' || p_name | 'Right' | true"),
            ("p_partkey % 3 = 1", "'' | p_name || ' ' | 200 | 300 + p_size * 10 | 100 + p_size * 10 | p_name || ' (' || p_brand || ')' | 'Right' | true"),
            ("p_partkey % 3 = 2", "'' | p_name || ' ' | 200 | 200 + p_size | p_size | p_name || ' ' | 'Right' | true"),
        ],
    )
)
def line_with_sub_line(spark, sf_dir):
    kind, x = F.col("p_partkey") % 3, F.col("x")
    start = F.when(kind == 0, 100).otherwise(300)
    sub = F.when(kind != 2, model.syllable_line(_one(_doc(" (@p_brand@) "), start, start + F.col("p_size") * 10), sub=True))
    main = model.syllable_line(_one(_doc("@p_name@ "), 200, F.col("p_size") + 200))
    made = _parts(spark, sf_dir).select("p_partkey", model.with_alignment(model.with_sub_line(main, sub), "Right").cast(LINE).alias("x"))
    return made.select(
        "p_partkey", model.text_of(x).alias("own_text"), model.any_text(x).alias("any_text"), model.start_with_sub(x).alias("start_ms"), model.end_with_sub(x).alias("end_ms"),
        model.duration_with_sub(x).alias("duration_ms"), model.full_text(x).alias("full_text"), x["alignment"].alias("alignment"), x["is_syllable"].alias("is_syllable"),
    )


@query(
    _expected(
        "is_full text start_ms zh n_translations pronunciation",
        [
            ("p_partkey % 6 = 0", "true | p_name | 0 | 'new ' || p_size | 2 | 'pron'"),  # a full line, set
            ("p_partkey % 6 = 1", "true | p_name | 5 | NULL | 1 | 'pron'"),  # a full syllable line, removed by ''
            ("p_partkey % 6 = 2", "true | p_name | 7 | 'new ' || p_size | 2 | NULL"),  # a plain line, promoted, set
            ("p_partkey % 6 = 3", "true | p_name | 5 | NULL | 1 | NULL"),  # a syllable line, promoted, removed by null
            ("p_partkey % 6 = 4", "false | p_name | 7 | NULL | 0 | NULL"),  # a plain line is left alone when syllables are promoted
            ("p_partkey % 6 = 5", "false | p_name | 0 | NULL | 0 | NULL"),  # nothing is set on a plain line
        ],
    )
)
def line_translations(spark, sf_dir):
    told = F.create_map(F.lit("zh"), F.lit("old"), F.lit("en"), F.col("p_brand"))
    null = F.lit(None).cast("int")
    plain, timed = model.line(F.col("p_name"), F.lit(7)), model.syllable_line(_one(F.col("p_name"), 5, 9))
    new = _doc("new @p_size@")
    full = model.full_line(F.col("p_name"), null, null, told, F.lit("pron"))
    forms = [
        model.with_translation(full, new),
        model.with_translation(model.full_syllable_line(_one(F.col("p_name"), 5, 9), told, F.lit("pron")), F.lit("")),
        model.with_translation(model.to_full(plain, told), new),
        model.with_translation(model.to_full(timed, told, only_syllables=True), F.lit(None).cast("string")),
        model.to_full(plain, told, only_syllables=True),
        model.with_translation(model.line(F.col("p_name")), new),
    ]
    made = F.lit(None).cast(LINE)
    for i, f in enumerate(forms):
        made = F.when(F.col("p_partkey") % 6 == i, f.cast(LINE)).otherwise(made)
    x = F.col("x")
    return _parts(spark, sf_dir).select("p_partkey", made.alias("x")).select(
        "p_partkey", x["is_full"].alias("is_full"), model.any_text(x).alias("text"), model.start_or_zero(x).alias("start_ms"), model.translation(x).alias("zh"),
        F.greatest(F.coalesce(F.size(x["translations"]), F.lit(0)), F.lit(0)).alias("n_translations"), x["pronunciation"].alias("pronunciation"),
    )


@query(
    "SELECT p_partkey, p_name || p_brand AS text, CAST(10 AS INTEGER) AS start_ms, 30 + p_size AS end_ms, 20 + p_size AS duration_ms, 0 AS empty_start, 0 AS empty_end, "
    "1 AS n_general, 1 AS n_krc, 'h' || p_size AS hash, CAST(NULL AS VARCHAR) AS general_hash, true AS spotify_has_none, "
    "CASE WHEN p_partkey % 2 = 0 THEN 'spotify:track:' || p_brand END AS uri, 'A|B' AS split_artists, 'kept' AS kept_artists, p_name || ', ' || p_brand AS set_artist, "
    "'X|Y' AS split_album, p_brand || ', z' AS set_album, 'z' AS last_album FROM part"
)
def groups_and_metadata(spark, sf_dir):
    two = F.concat(_one(F.col("p_name"), 10, 15), _one(F.col("p_brand"), 20, F.col("p_size") + 30))
    group, empty = model.group_of(two), model.group_of(F.array().cast(f"array<{SYLLABLE}>"))
    attrs = F.array(F.struct(F.lit("k").alias("key"), F.col("p_name").alias("value")))
    general, krc = model.general_info(attrs), model.krc_info(attrs, _doc("h@p_size@"))
    spotify = model.spotify_info(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))
    meta = model.metadata(artist="A, B", album_artist="X, Y", spotify_id=F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")))
    kept = model.ensure_artists(model.metadata(artist="A, B", artists=F.array(F.lit("kept"))))
    album = model.with_album_artists(meta, F.array(F.col("p_brand"), F.lit("z")))
    return _parts(spark, sf_dir).select(
        "p_partkey", group["text"].alias("text"), group["start_ms"].alias("start_ms"), group["end_ms"].alias("end_ms"), group["duration_ms"].alias("duration_ms"),
        empty["start_ms"].alias("empty_start"), empty["end_ms"].alias("empty_end"), F.size(model.info_attributes(general)).alias("n_general"), F.size(model.info_attributes(krc)).alias("n_krc"),
        model.info_hash(krc).alias("hash"), model.info_hash(general).alias("general_hash"), model.info_attributes(spotify).isNull().alias("spotify_has_none"), model.spotify_uri(meta).alias("uri"),
        F.array_join(model.ensure_artists(meta)["artists"], "|").alias("split_artists"), F.array_join(kept["artists"], "|").alias("kept_artists"),
        model.with_artists(meta, F.array("p_name", "p_brand"))["artist"].alias("set_artist"), F.array_join(model.ensure_artists(meta)["album_artists"], "|").alias("split_album"),
        album["album_artist"].alias("set_album"), F.element_at(album["album_artists"], -1).alias("last_album"),
    )


# --- text ----------------------------------------------------------------------------------------------------------

_MARKS = ". , ! ? ; : - ( ) 。 ， ！ ？ ； ： — （ ） a 1 _".split()


@query(
    "SELECT p_partkey, p_name || p_brand AS one_line, p_name || ' ' || p_brand AS spaced, p_partkey % 21 < 18 AS is_mark, p_partkey % 4 = 0 AS is_lrc, p_partkey % 4 < 2 AS bracketed, "
    "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE '(' || p_name END AS inside, "
    "CASE WHEN p_partkey % 4 = 0 THEN p_size * 1500 WHEN p_partkey % 4 = 1 THEN 60000 + p_size * 1000 WHEN p_partkey % 4 = 2 THEN 3660000 + p_size * 1000 END AS clock, "
    "CASE p_partkey % 4 WHEN 0 THEN 'und' WHEN 1 THEN 'zh' WHEN 2 THEN 'zh' ELSE 'fr' END AS lang FROM part"
)
def text_edges(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    pick = lambda values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (F.col("p_partkey") % len(values)).cast("int") + 1)
    bracketed = _cases(["(@p_name@)", "（@p_name@）", "(@p_name@", "@p_name@)"])
    clock = F.when(kind == 0, F.format_string("%.3fS", F.col("p_size") * 1.5)).when(kind == 1, F.format_string("1:%02d.000", "p_size")).when(kind == 2, F.format_string("1:1:%d", "p_size")).otherwise("x")
    return _parts(spark, sf_dir).select(
        "p_partkey",
        text.one_line(_doc("@p_name@\r\n@p_brand@\n")).alias("one_line"),
        text.normal_spaces(_doc("　@p_name@  \n @p_brand@\t")).alias("spaced"),
        text.is_punctuation(pick(_MARKS)).alias("is_mark"),
        detect.is_lrc(_cases(["[00:01]@p_name@", "<0,1,0>[a:b]", "[1,2],(1,2,0):", "@p_name@"])).alias("is_lrc"),
        syllabic.is_bracketed(model.line(bracketed)).alias("bracketed"),
        F.when(kind == 3, _doc("(@p_name@")).otherwise(text.strip_brackets(bracketed)).alias("inside"),
        text.clock_ms(clock).alias("clock"),
        text.language_key(pick(["  ", "zh-Hant", "ZH", " fr "])).alias("lang"),
    )


@query(
    "SELECT p_partkey, '简体中文转换，头发和发现 ' || p_name AS simplified, '頭髮發現後來皇后萬里 ' || p_name AS traditional, '乾隆乾杯' AS kept, '汉字' AS own FROM part"
)
def script_conversion(spark, sf_dir):
    p = _parts(spark, sf_dir)
    own = text.to_simplified(F.lit("某字"), phrases={"某": "汉"})
    return p.select(
        "p_partkey", text.to_simplified(_doc("簡體中文轉換，頭髮和發現 @p_name@")).alias("simplified"), text.to_traditional(_doc("头发发现后来皇后万里 @p_name@")).alias("traditional"),
        text.to_simplified(F.lit("乾隆乾杯"), phrases={"乾隆": "乾隆", "乾杯": "乾杯"}).alias("kept"), own.alias("own"),
    )


# --- dialects ------------------------------------------------------------------------------------------------------

_FORM_TYPES = [
    ("lrc", "lrc", "'LineSynced' | 1 | p_name"),
    ("lines", "qrc", "'LineSynced' | 1 | p_name || '(0,' || p_size || ')'"),
    ("krc", "krc", "'SyllableSynced' | 0 | NULL"),
    ("syllable", "yrc", "'SyllableSynced' | 0 | NULL"),
    ("qrc", "syllable", "'SyllableSynced' | 1 | p_name"),
    ("spotify", "spotify", "NULL | NULL | NULL"),
    ("musixmatch", "musixmatch", "NULL | NULL | NULL"),
    ("ttml", "ttml", "'Unknown' | 0 | NULL"),
    ("lines", "lines", "'LineSynced' | 1 | p_name"),
    ("unknown", "unknown", "NULL | NULL | NULL"),
]


@query(_expected("raw_type strict_type sync_type n_lines first_text", [(f"p_partkey % 10 = {i}", f"'{a}' | '{b}' | {rest}") for i, (a, b, rest) in enumerate(_FORM_TYPES)]))
def detect_then_parse(spark, sf_dir):
    docs = _parts(spark, sf_dir).select("p_partkey", F.expr(FORM).alias("text"))
    lines = F.col("parsed.lines")
    return convert.parse(docs).select(
        "p_partkey", "raw_type", detect.detect_strict(F.col("text")).alias("strict_type"), F.col("parsed.sync_type").alias("sync_type"),
        F.when(lines.isNotNull(), F.size(lines)).alias("n_lines"), model.any_text(F.get(lines, F.lit(0))).alias("first_text"),
    )


@query("SELECT p_partkey, 'shout' AS raw_type, upper(p_name) AS text FROM part")
def registered_dialect(spark, sf_dir):
    from strophe.schemas import PARSED, struct

    convert.register("shout", lambda c: struct(PARSED, lyrics_type="shout", sync_type="Unsynced", lines=F.array(model.line(F.upper(c))).cast(_LINES)))
    try:
        out = convert.parse(_parts(spark, sf_dir), "p_name", "shout")
    finally:
        convert.PARSERS.pop("shout")
    return out.select("p_partkey", "raw_type", F.get(F.col("parsed.lines"), F.lit(0))["text"].alias("text"))


_LRC = "[ti:@p_name@]\n[ar:A]\n[length:@p_size@]\n[00:02.00][00:01.5]x\n[offset:250]\n[00:03.123]y @p_size@\n[00:01:25]z\nno stamp\n[00:10]\n"
_LRC_LINES = [("0", "1000 | 'z'"), ("1", "1500 | 'x'"), ("2", "2000 | 'x'"), ("3", "2873 | 'y ' || p_size"), ("4", "9750 | ''")]


@query(_expected("line_no start_ms text title duration_ms n_attributes", [("true", f"{n} | {v} | p_name | p_size | 4") for n, v in _LRC_LINES]))
def lrc_stamps_and_offset(spark, sf_dir):
    doc = _parts(spark, sf_dir).select("p_partkey", lrc.parse(_doc(_LRC)).alias("d"))
    own = doc.select("p_partkey", F.col("d.metadata.title").alias("title"), F.col("d.metadata.duration_ms").alias("duration_ms"), F.size("d.additional_info.attributes").alias("n_attributes"), F.col("d.lines").alias("lines"))
    return explode_lines(own).select("p_partkey", "line_no", "start_ms", "text", "title", "duration_ms", "n_attributes")


_LANGUAGE = '{"content":[{"type":0,"language":0,"lyricContent":[["no"]]},{"type":1,"language":0,"lyricContent":[["t @p_size@"],null,["//"],["last"]]}],"version":1}'
_KRC = "[id:x]\n[ti:@p_name@]\n[hash:abc]\n[offset:100]\n@tag@[1000,500]<0,200,0>@p_name@<200,300,0> b\n[2000,400]<0,400,0>c\n[3000,100]<0,100,0>d\nnot a line"
_KRC_LINES = [("0", "p_name || ' b'", 1000, 1500, "'t ' || p_size"), ("1", "'c'", 2000, 2400, "NULL"), ("2", "'d'", 3000, 3100, "'last'")]
_KRC_ROWS = [
    (f"p_partkey % 2 = {k}", f"'{how}' | {n} | {t} | {a - shift} | {b - shift} | {'true' if k == 0 else 'false'} | {zh if k == 0 else 'NULL'} | {'true' if k == 0 else 'false'}")
    for k in (0, 1)
    for how, shift in (("whole", 100), ("lines", 0))
    for n, t, a, b, zh in _KRC_LINES
]


@query(_expected("how line_no text start_ms end_ms is_full zh has_translation", _KRC_ROWS))
def krc_translations(spark, sf_dir):
    tag = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[language:"), F.base64(_doc(_LANGUAGE).cast("binary")), F.lit("]\n"))).otherwise("")
    docs = _parts(spark, sf_dir).withColumn("tag", tag).select("p_partkey", _doc(_KRC).alias("c"))
    has = syllabic.has_krc_translation(F.col("c")).alias("has_translation")
    whole = docs.select("p_partkey", F.lit("whole").alias("how"), has, syllabic.parse_krc(F.col("c"))["lines"].alias("lines"))
    lines = docs.select("p_partkey", F.lit("lines").alias("how"), has, syllabic.parse_krc_lines(F.col("c")).alias("lines"))
    rows = whole.unionByName(lines).select("p_partkey", "how", "has_translation", F.posexplode("lines").alias("line_no", "x"))
    x = F.col("x")
    return rows.select("p_partkey", "how", "line_no", model.any_text(x).alias("text"), model.start_of(x).alias("start_ms"), model.end_of(x).alias("end_ms"), x["is_full"].alias("is_full"), model.translation(x).alias("zh"), "has_translation")


@query("SELECT p_partkey, p_name AS title, 'abc' AS hash, 4 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END - 1 AS n_attributes, 'Krc' AS type FROM part")
def krc_header(spark, sf_dir):
    tag = F.when(F.col("p_partkey") % 2 == 0, "[language:e30=]\n").otherwise("")
    doc = _parts(spark, sf_dir).withColumn("tag", tag).select("p_partkey", syllabic.parse_krc(_doc(_KRC)).alias("d"))
    return doc.select("p_partkey", F.col("d.metadata.title").alias("title"), F.col("d.additional_info.hash").alias("hash"), F.size("d.additional_info.attributes").alias("n_attributes"), F.col("d.additional_info.type").alias("type"))


_CREDITS = '{"t":0,"c":[{"tx":"作词: "},{"tx":"@p_brand@"},{"tx":"/"},{"tx":"Z"}]}\n{"t":1000,"c":[{"tx":"作曲: "},{"tx":"Q"}]}\n'
_YRC = "[2000,500](2000,200,0)@p_name@(2200,300,0) b\n[3000,100](3000,100,0)c"
_YRC_CASES = [_CREDITS + _YRC + '\n{"t":4000,"c":[{"tx":"end"}]}', _YRC]
_SUNG = ["p_name || ' b' | 2000 | 2500", "'c' | 3000 | 3100"]
_TOLD = ["'作词: ' || p_brand || '/Z' | 0 | NULL", "'作曲: Q' | 1000 | NULL"]


@query(
    _expected(
        "line_no text start_ms end_ms sync_type writers in_lines",
        [("p_partkey % 2 = 0", f"{i} | {v} | 'MixedSynced' | p_brand || '|Z' | {i < 4}") for i, v in enumerate([*_TOLD, *_SUNG, "'end' | 4000 | NULL"])]
        + [("p_partkey % 2 = 1", f"{i} | {v} | 'SyllableSynced' | '' | true") for i, v in enumerate(_SUNG)],
    )
)
def yrc_credits(spark, sf_dir):
    docs = _parts(spark, sf_dir).select("p_partkey", _cases(_YRC_CASES).alias("c"))
    doc = docs.select("p_partkey", syllabic.parse_yrc(F.col("c")).alias("d"), F.size(syllabic.parse_yrc_lines(F.col("c"))).alias("n"))
    rows = doc.select("p_partkey", "n", F.col("d.sync_type").alias("sync_type"), F.coalesce(F.array_join("d.writers", "|"), F.lit("")).alias("writers"), F.posexplode("d.lines").alias("line_no", "x"))
    x = F.col("x")
    return rows.select("p_partkey", "line_no", model.any_text(x).alias("text"), model.start_of(x).alias("start_ms"), model.end_of(x).alias("end_ms"), "sync_type", "writers", (F.col("line_no") < F.col("n")).alias("in_lines"))


@query(_expected("text start_ms end_ms", [("true", "p_name || ',' | 0 | 20"), ("true", "'，' | 20 | 30"), ("true", "'b' | 30 | 40")]))
def yrc_tidy(spark, sf_dir):
    made = F.concat(_one(F.col("p_name"), 0, 10), _one(F.lit(","), 10, 20), _one(F.lit("，"), 20, 30), _one(F.lit("b "), 30, 40))
    lines = clean.tidy_yrc(F.array(model.syllable_line(made)).cast(_LINES))
    return _parts(spark, sf_dir).select("p_partkey", F.explode(F.get(lines, F.lit(0))["syllables"]).alias("s")).select("p_partkey", "s.*")


@query(_expected("line_no n_syllables text", [("true", "0 | 1 | p_name"), ("true", "1 | 0 | ''"), ("true", "2 | 1 | 'b'")]))
def qrc_empty_line(spark, sf_dir):
    doc = _doc("[ti:x]\n[0,10]@p_name@(0,10)\n[20,30]\n[50,10]b(50,10)")
    rows = _parts(spark, sf_dir).select("p_partkey", F.posexplode(syllabic.parse_qrc(doc)["lines"]).alias("line_no", "x"))
    return rows.select("p_partkey", "line_no", F.size("x.syllables").alias("n_syllables"), model.any_text(F.col("x")).alias("text"))


_SIDES = "[4]@p_name@(0,10)\n[5]b(10,10)\n[7](oh)(15,3)\n[3]c(20,10)\n[0]（plain）(30,10)\n[1]d(40,10)"


@query(
    _expected(
        "line_no text alignment sub",
        [("true", "0 | p_name | 'Left' | NULL"), ("true", "1 | 'b' | 'Right' | '(oh)'"), ("true", "2 | 'c' | 'Unspecified' | '（plain）'"), ("true", "3 | 'd' | 'Left' | NULL")],
    )
)
def syllable_sides(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("p_partkey", F.posexplode(syllabic.parse_syllable(_doc(_SIDES))["lines"]).alias("line_no", "x"))
    x = F.col("x")
    return rows.select("p_partkey", "line_no", model.any_text(x).alias("text"), x["alignment"].alias("alignment"), F.when(x["sub_line"].isNotNull(), model.any_text(x["sub_line"])).alias("sub"))


_SPOTIFY = [
    '{"lyrics":{"syncType":"UNSYNCED","lines":[{"startTimeMs":"0","words":"@p_name@","syllables":[],"endTimeMs":"0"},{"startTimeMs":"5","words":"","syllables":[]}],"provider":"M","providerLyricsId":"7","providerDisplayName":"D","language":"en"}}',
    '{"lyrics":{"syncType":"LINE_SYNCED","lines":[{"startTimeMs":"bad","words":"@p_name@","syllables":[],"endTimeMs":"0"},{"startTimeMs":"@p_size@","words":"b","endTimeMs":"99"}],"provider":"M","providerLyricsId":"7","providerDisplayName":"D","language":"en"}}',
]


@query(
    _expected(
        "line_no text start_ms end_ms sync_type provider",
        [
            ("p_partkey % 2 = 0", "0 | p_name | NULL | NULL | 'Unsynced' | 'M7Den'"),
            ("p_partkey % 2 = 0", "1 | '' | NULL | NULL | 'Unsynced' | 'M7Den'"),
            ("p_partkey % 2 = 1", "0 | p_name | 0 | NULL | 'LineSynced' | 'M7Den'"),
            ("p_partkey % 2 = 1", "1 | 'b' | p_size | 99 | 'LineSynced' | 'M7Den'"),
        ],
    )
)
def spotify_unsynced(spark, sf_dir):
    doc = _parts(spark, sf_dir).select("p_partkey", json_dialects.parse_spotify(_cases(_SPOTIFY)).alias("d"))
    i = F.col("d.additional_info")
    rows = doc.select("p_partkey", F.col("d.sync_type").alias("sync_type"), F.concat(i["provider"], i["provider_lyrics_id"], i["provider_display_name"], i["lyrics_language"]).alias("provider"), F.col("d.lines").alias("lines"))
    return explode_lines(rows).select("p_partkey", "line_no", "text", "start_ms", "end_ms", "sync_type", "provider")


def _calls(rich: int, subtitle: int, plain: int) -> str:
    header = '"header":{"status_code":%d}'
    body = r'[{\"ts\":1.5,\"te\":2.5,\"l\":[{\"c\":\"@p_name@\",\"o\":0},{\"c\":\" \",\"o\":0.25},{\"c\":\"b\",\"o\":0.5}],\"x\":\"\"}]'
    calls = [
        '"track.richsync.get":{"message":{%s,"body":{"richsync":{"richsync_body":"%s","richssync_language":"en"}}}}' % (header % rich, body),
        '"track.subtitles.get":{"message":{%s,"body":{"subtitle_list":[{"subtitle":{"subtitle_body":"[00:01.00]@p_name@\\n[00:02.00]","subtitle_language":"fr"}}]}}}' % (header % subtitle),
        '"track.lyrics.get":{"message":{%s,"body":{"lyrics":{"lyrics_body":"a\\n\\n@p_name@"}}}}' % (header % plain),
    ]
    return '{"message":{"body":{"macro_calls":{%s}}}}' % ",".join(calls)


@query(
    _expected(
        "line_no text n_syllables start_ms end_ms second_start sync_type language",
        [
            ("p_partkey % 4 = 0", "0 | p_name || ' b' | 3 | 1500 | 2500 | 1750 | 'SyllableSynced' | 'en'"),
            ("p_partkey % 4 = 1", "0 | p_name | NULL | 1000 | NULL | NULL | 'LineSynced' | 'fr'"),
            ("p_partkey % 4 = 1", "1 | '' | NULL | 2000 | NULL | NULL | 'LineSynced' | 'fr'"),
            ("p_partkey % 4 = 2", "0 | 'a' | NULL | NULL | NULL | NULL | 'Unsynced' | NULL"),
            ("p_partkey % 4 = 2", "1 | '' | NULL | NULL | NULL | NULL | 'Unsynced' | NULL"),
            ("p_partkey % 4 = 2", "2 | p_name | NULL | NULL | NULL | NULL | 'Unsynced' | NULL"),
        ],
    )
)
def musixmatch_routes(spark, sf_dir):
    doc = _parts(spark, sf_dir).select("p_partkey", json_dialects.parse_musixmatch(_cases([_calls(200, 200, 200), _calls(404, 200, 200), _calls(404, 404, 200), _calls(404, 404, 404)])).alias("d"))
    rows = doc.select("p_partkey", F.col("d.sync_type").alias("sync_type"), F.array_join("d.metadata.language", ",").alias("language"), F.posexplode("d.lines").alias("line_no", "x"))
    x = F.col("x")
    n = F.when(x["is_syllable"], F.size(x["syllables"]))
    return rows.select("p_partkey", "line_no", model.any_text(x).alias("text"), n.alias("n_syllables"), model.start_of(x).alias("start_ms"), model.end_of(x).alias("end_ms"), F.get(x["syllables"], F.lit(1))["start_ms"].alias("second_start"), "sync_type", "language")


# --- TTML ----------------------------------------------------------------------------------------------------------

_TT = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata" xmlns:itunes="urn:itunes"><head><metadata>%s</metadata></head><body><div>%s</div></body></tt>'
_TTML = [
    _TT
    % (
        '<ttm:agent type="person" xml:id="v1"/><ttm:agent type="group" xml:id="v2"/><iTunesMetadata leadingSilence="0.5"><songwriters><songwriter>@p_brand@</songwriter><songwriter> X Y </songwriter></songwriters></iTunesMetadata>',
        '<p begin="1" end="3" ttm:agent="v1"><span begin="1.000" end="1.500">@p_name@</span> <span begin="1.500" end="2.000">one</span>'
        '<span ttm:role="x-bg"><span begin="2.1" end="2.2">( oh</span> <span begin="2.2" end="2.5">no )</span></span></p><p begin="4" end="5" ttm:agent="v2">plain @p_size@</p>',
    ),
    _TT
    % (
        '<ttm:agent type="person" xml:id="a1"/><ttm:agent type="person" xml:id="a2"/><ttm:agent type="other" xml:id="a3"/>',
        '<p begin="00:01:02.500" end="1:03.250" ttm:agent="a1">one</p><p begin="70s" end="71.5s" ttm:agent="a2">@p_name@</p><p begin="80" end="81" ttm:agent="a3">three</p>',
    ),
    _TT
    % (
        '<iTunesMetadata><translations><translation type="subtitle" xml:lang="zh-Hans"><text for="L1">译 (背)</text></translation><translation type="subtitle" xml:lang="en"><text for="L1">tr @p_size@</text></translation></translations></iTunesMetadata>',
        '<p begin="1" end="3" itunes:key="L1"><span begin="1" end="2">@p_name@</span><span ttm:role="x-bg"><span begin="2" end="3">(back)</span></span></p><p begin="4" end="5" itunes:key="L2">none</p>',
    ),
    _TT
    % (
        '<iTunesMetadata><translations><translation type="replacement" xml:lang="en"><text for="L1">vwxyz</text><text for="L2">longer @p_name@</text><text for="L3">MAIN ( sub )</text></translation></translations></iTunesMetadata>',
        '<p begin="1" end="2" itunes:key="L1"><span begin="1" end="1.5">abc</span><span begin="1.5" end="2">de</span></p>'
        '<p begin="3" end="4" itunes:key="L2"><span begin="3" end="3.5">abc</span><span begin="3.5" end="4">de</span></p>'
        '<p begin="5" end="6" itunes:key="L3"><span begin="5" end="5.5">ma</span><span begin="5.5" end="6">in</span><span ttm:role="x-bg"><span begin="6" end="7">xx</span></span></p>',
    ),
    _TT % ("", '<p begin="1" end="2">Fish &amp; @p_name@</p><p begin="3" end="4"> </p><p>untimed</p><p begin="5"><span>no time</span></p>'),
]
_TTML_COLUMNS = "line_no text n_syllables last_text start_ms end_ms alignment sub sub_start sub_end zh en sub_zh is_full sync_type writers silence"


@query(
    _expected(
        _TTML_COLUMNS,
        [
            ("p_partkey % 5 = 0", "0 | p_name || ' one' | 2 | 'one' | 1000 | 2000 | 'Left' | '(oh no)' | 2100 | 2500 | NULL | NULL | NULL | false | 'MixedSynced' | p_brand || '|X Y' | '0.5'"),
            ("p_partkey % 5 = 0", "1 | 'plain ' || p_size | NULL | NULL | 4000 | 5000 | 'Right' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'MixedSynced' | p_brand || '|X Y' | '0.5'"),
            ("p_partkey % 5 = 1", "0 | 'one' | NULL | NULL | 62500 | 63250 | 'Left' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'LineSynced' | NULL | NULL"),
            ("p_partkey % 5 = 1", "1 | p_name | NULL | NULL | 70000 | 71500 | 'Right' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'LineSynced' | NULL | NULL"),
            ("p_partkey % 5 = 1", "2 | 'three' | NULL | NULL | 80000 | 81000 | 'Left' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'LineSynced' | NULL | NULL"),
            ("p_partkey % 5 = 2", "0 | p_name | 1 | p_name | 1000 | 2000 | 'Unspecified' | '(back)' | 2000 | 3000 | '译' | 'tr ' || p_size | '背' | true | 'MixedSynced' | NULL | NULL"),
            ("p_partkey % 5 = 2", "1 | 'none' | NULL | NULL | 4000 | 5000 | 'Unspecified' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'MixedSynced' | NULL | NULL"),
            ("p_partkey % 5 = 3", "0 | 'vwxyz' | 2 | 'yz' | 1000 | 2000 | 'Unspecified' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'SyllableSynced' | NULL | NULL"),
            ("p_partkey % 5 = 3", "1 | 'longer ' || p_name | 1 | 'longer ' || p_name | 3000 | 4000 | 'Unspecified' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'SyllableSynced' | NULL | NULL"),
            ("p_partkey % 5 = 3", "2 | 'MAIN' | 2 | 'IN' | 5000 | 6000 | 'Unspecified' | '(sub)' | 6000 | 7000 | NULL | NULL | NULL | false | 'SyllableSynced' | NULL | NULL"),
            ("p_partkey % 5 = 4", "0 | 'Fish & ' || p_name | NULL | NULL | 1000 | 2000 | 'Unspecified' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'LineSynced' | NULL | NULL"),
            ("p_partkey % 5 = 4", "1 | 'no time' | NULL | NULL | 5000 | NULL | 'Unspecified' | NULL | NULL | NULL | NULL | NULL | NULL | false | 'LineSynced' | NULL | NULL"),
        ],
    )
)
def ttml_features(spark, sf_dir):
    doc = _parts(spark, sf_dir).select("p_partkey", ttml.parse(_cases(_TTML)).alias("d"))
    silence = F.get(F.filter("d.additional_info.attributes", lambda a: a["key"] == "leadingSilence"), F.lit(0))["value"]
    rows = doc.select("p_partkey", F.col("d.sync_type").alias("sync_type"), F.array_join("d.writers", "|").alias("writers"), silence.alias("silence"), F.posexplode("d.lines").alias("line_no", "x"))
    x, under = F.col("x"), F.col("x.sub_line")
    return rows.select(
        "p_partkey", "line_no", model.any_text(x).alias("text"), F.when(x["is_syllable"], F.size(x["syllables"])).alias("n_syllables"), F.try_element_at(x["syllables"], F.lit(-1))["text"].alias("last_text"),
        model.start_of(x).alias("start_ms"), model.end_of(x).alias("end_ms"), x["alignment"].alias("alignment"), F.when(under.isNotNull(), model.any_text(under)).alias("sub"), model.start_of(under).alias("sub_start"),
        model.end_of(under).alias("sub_end"), model.translation(x).alias("zh"), model.translation(x, "en").alias("en"), model.translation(under).alias("sub_zh"), x["is_full"].alias("is_full"), "sync_type", "writers", "silence",
    )


# --- writing -------------------------------------------------------------------------------------------------------

_HEAD = "'[ti:' || p_name || ']' || chr(10) || '[ar:' || p_brand || ']' || chr(10) || "
_NL = " || chr(10) || "


@query(
    "SELECT p_partkey, "
    + _HEAD + _NL.join(["'[00:01.000](sub) main'", "'[00:02.000]'", "'[00:09.000]plain ' || p_size", "'[00:09.500]'", "''"]) + " AS all_in_main, "
    + _HEAD + _NL.join(["'[00:01.000]main'", "'[00:00.500]sub'", "'[00:09.000]plain ' || p_size", "''"]) + " AS none_separate, "
    + _NL.join(["'[00:01.000](sub) main'", "'[00:02.000]'", "'[00:09.000]plain ' || p_size", "'[00:09.500]'", "''"]) + " AS huge, "
    + _NL.join(["'[1000,2000]main'", "'[500,1500]sub'", "'[9000,9500]plain ' || p_size", "''"]) + " AS lines_separate, "
    + _NL.join(["'[5]main(1000,1000)'", "'[8]sub(500,1000)'", "''"]) + " AS sides, true AS blank FROM part"
)
def writing_options(spark, sf_dir):
    sub = model.with_alignment(model.syllable_line(_one(F.lit("sub"), 500, 1500), sub=True), "Right")
    main = model.with_alignment(model.with_sub_line(model.syllable_line(_one(F.lit("main"), 1000, 2000)), sub), "Right").cast(LINE)
    lines = F.array(main, model.line(_doc("plain @p_size@"), F.lit(9000), F.lit(9500)).cast(LINE), model.line(F.lit("untimed")).cast(LINE)).cast(_LINES)
    meta = model.metadata(title=F.col("p_name"), artist=F.col("p_brand"))
    from strophe.schemas import PARSED, struct

    nothing = struct(PARSED, lines=F.array(model.line(F.lit("untimed")).cast(LINE)).cast(_LINES))
    return _parts(spark, sf_dir).select(
        "p_partkey", generate.lrc(lines, meta, "all").alias("all_in_main"), generate.lrc(lines, meta, "none", "separate").alias("none_separate"), generate.lrc(lines).alias("huge"),
        generate.lines_dialect(lines, "separate").alias("lines_separate"), generate.syllable(lines).alias("sides"), generate.generate(nothing, "lrc").isNull().alias("blank"),
    )


# --- containers ----------------------------------------------------------------------------------------------------

# Containers made apart from the engine, by a few lines over zlib and the format's key (KRC) and by the cipher (QRC).
_KRC_FILE = "a3JjMTidGijOoeze9mavclqAwpkiOk4g6rP6Jv07of3/YsVpQPiKfZ8="
_QRC_HEX = "5FD4440BA022BF603715CABBF0A50E85DA8E47649D3C47FC"


@query("SELECT s_suppkey, 'plain words 词' || chr(10) || '[0,1]<0,1,0>x' AS krc, 'plain words 词' || chr(10) || '[0,1]<0,1,0>x' AS krc_bytes, CASE WHEN s_suppkey % 2 = 1 THEN 'DecompressionFailed' END AS error, '[0,10]word(0,10)' AS qrc FROM supplier")
def known_containers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit(_KRC_FILE), F.substring("s_name", 1, 0)).alias("krc"), F.concat(F.lit(_QRC_HEX), F.substring("s_name", 1, 0)).alias("qrc"))
    whole = F.unbase64("krc")
    broken = F.when(F.col("s_suppkey") % 2 == 1, F.lit("krc1 no zlib stream").cast("binary")).otherwise(whole)
    return s.withColumns({"file": whole, "broken": broken}).select(
        "s_suppkey", containers.decode_krc(F.col("krc")).alias("krc"), containers.decode_krc_bytes(F.col("file")).alias("krc_bytes"), containers.decode_krc_result(F.col("broken"))["error"].alias("error"), containers.decode_qrc(F.col("qrc")).alias("qrc")
    )


# --- matching and catalogues ---------------------------------------------------------------------------------------

_PAIRS = [
    ("@p_name@ (Deluxe Edition)", "@p_name@", "VeryHigh"),
    ("@p_name@ (feat. X)", "@p_name@ (Explicit)", "High"),
    ("@p_name@ (live at home)", "@p_name@", "Medium"),
    ("@p_name@", "@p_name@ [Bonus Track]", "VeryHigh"),
    ("@p_name@（with Q）", "@p_name@", "VeryHigh"),
    ("@p_name@ (with Aaaa)", "@p_name@ (with Bbbb)", "High"),
    ("a’s @p_name@", "A's @p_name@", "VeryHigh"),
    ("@p_name@ - Live", "@p_name@ (Live", "VeryHigh"),
    ("@p_name@", " @p_name@ ", "Perfect"),
]


@query(_expected("label", [(f"p_partkey % {len(_PAIRS)} = {i}", f"'{label}'") for i, (_, _, label) in enumerate(_PAIRS)]))
def name_suffixes(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", match.name_match(_cases([a for a, _, _ in _PAIRS]), _cases([b for _, b, _ in _PAIRS])).alias("label"))


@query(
    """WITH s AS (SELECT p_partkey, p_size * 0.5 AS s, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE WHEN s > 21 THEN 'Perfect' WHEN s > 19 THEN 'VeryHigh' WHEN s > 17 THEN 'High' WHEN s > 15 THEN 'PrettyHigh' WHEN s > 11 THEN 'Medium' WHEN s > 8 THEN 'Low' WHEN s > 3 THEN 'VeryLow' ELSE 'NoMatch' END AS level,
  CASE WHEN s > 21 THEN 100 WHEN s > 19 THEN 99 WHEN s > 17 THEN 95 WHEN s > 15 THEN 90 WHEN s > 11 THEN 70 WHEN s > 8 THEN 30 WHEN s > 3 THEN 10 ELSE -1 END AS value,
  CAST(CASE k WHEN 0 THEN 7 + 6 + 0.4 * 5 + 0.2 * 4 + 2 WHEN 1 THEN (7 + 6 + 0.2 * 4 + 2) * 30 / (30 - 2.8) WHEN 2 THEN (7 + 6 + 0.4 * 5 + 2) * 30 / (30 - 1.4) WHEN 3 THEN (7 + 6 + 0.4 * 5 + 0.2 * 4) * 30 / (30 - 7) ELSE (7 + 6) * 30 / (30 - 11.2) END AS DOUBLE) AS score FROM s"""
)
def score_levels(spark, sf_dir):
    k = F.col("p_partkey") % 5
    album, album_artist, duration = (F.when(~k.isin(missing), label) for label, missing in (("High", [1, 4]), ("Medium", [2, 4]), ("Low", [3, 4])))
    s = F.col("p_size") * 0.5
    return _parts(spark, sf_dir).select("p_partkey", match.level(s).alias("level"), match.level_value(s).alias("value"), match.track_score(F.lit("Perfect"), F.lit("VeryHigh"), album, album_artist, duration).alias("score"))


_ARTISTS = [  # lists of artists and of a candidate's, and the match by the rules in their order
    ("a|b", "A|B", "Perfect"), ("a|b|c", "a|b", "VeryHigh"), ("a", "a|b", "High"), ("a|b|c|d|e|f", "群星|x", "VeryHigh"),
    ("a|b|c|d|e|f|g|h|i", "a|b|c|d|e|f|x|y", "High"), ("abc def", "abc|x", "High"), ("xx abcd", "abcd|y", "High"), ("xx abc", "abc|y", "Medium"),
    ("a", "b|a|c", "Medium"), ("a|b|c|d", "a|b", "Low"), ("a", "b", "NoMatch"), ("簡", "简", "Perfect"),
]


@query(_expected("label", [(f"p_partkey % {len(_ARTISTS)} = {i}", f"'{label}'") for i, (_, _, label) in enumerate(_ARTISTS)]))
def artist_rules(spark, sf_dir):
    a, b = (F.split(_cases([x[i] for x in _ARTISTS]), r"\|") for i in (0, 1))
    return _parts(spark, sf_dir).select("p_partkey", match.artist_match(a, b).alias("label"))


_ANSWERS = {
    "apple_music": '{"results":{"songs":{"data":[{"id":"i@p_partkey@","attributes":{"name":"@p_name@","artistName":"@p_brand@, B","albumName":"@p_type@","durationInMillis":@p_size@}}]}}}',
    "lrclib": '[{"id":@p_partkey@,"trackName":"@p_name@","artistName":"@p_brand@ feat. B & C","albumName":"@p_type@","duration":@p_size@.25}]',
    "musixmatch": '{"message":{"header":{"status_code":200,"confidence":950},"body":{"track":{"track_id":@p_partkey@,"track_name":"@p_name@","artist_name":"@p_brand@ feat. B","album_name":"@p_type@","track_length":@p_size@}}}}',
    "qq_music": '{"code":0,"req_1":{"code":0,"data":{"body":{"song":{"list":[{"id":@p_partkey@,"mid":"m@p_partkey@","title":"@p_name@","singer":[{"name":"@p_brand@"},{"name":"B"}],"album":{"title":"@p_type@"},"interval":@p_size@}]}}}}}',
    "soda_music": '{"result_groups":[{"data":[{"entity":{}},{"entity":{"track":{"id":"s@p_partkey@","name":"@p_name@","artists":[{"name":"@p_brand@"}],"album":{"name":"@p_type@"},"duration":@p_size@}}}]},{"data":[]}]}',
    "spotify": '{"tracks":{"items":[{"id":"no album","name":"x","artists":[],"duration_ms":1},{"id":"p@p_partkey@","name":"@p_name@","artists":[{"name":"@p_brand@"}],"album":{"name":"@p_type@","artists":[{"name":"V"},{"name":"W"}]},"duration_ms":@p_size@}]}}',
}
_ANSWER_ROWS = [
    "'apple_music' | 'i' || p_partkey | NULL | p_brand || ', B' | NULL | p_size",
    "'lrclib' | CAST(p_partkey AS VARCHAR) | p_partkey | p_brand || ', B, C' | NULL | p_size * 1000 + 250",
    "'musixmatch' | CAST(p_partkey AS VARCHAR) | p_partkey | p_brand || ', B' | NULL | p_size * 1000",
    "'qq_music' | 'm' || p_partkey | p_partkey | p_brand || ', B' | NULL | p_size * 1000",
    "'soda_music' | 's' || p_partkey | NULL | p_brand | NULL | p_size",
    "'spotify' | 'p' || p_partkey | NULL | p_brand | 'V, W' | p_size",
]


@query(_expected("provider id numeric_id artist album_artist duration_ms title album cand_no", [("true", f"{row} | p_name | p_type | 0") for row in _ANSWER_ROWS]))
def adapter_answers(spark, sf_dir):
    p, out = _parts(spark, sf_dir), None
    for provider, template in _ANSWERS.items():
        answers = p.select(F.col("p_partkey").cast("string").alias("query"), _doc(template).alias("body"))
        found = catalogs.candidates(answers, provider)
        out = found if out is None else out.unionByName(found)
    return out.select(
        F.col("query").cast("long").alias("p_partkey"), "provider", "id", "numeric_id", catalogs.joined_artists(F.col("artists")).alias("artist"), catalogs.joined_artists(F.col("album_artists")).alias("album_artist"), "duration_ms", "title", "album", "cand_no"
    )


@query("SELECT p_partkey, 0 AS n FROM part WHERE p_partkey % 2 = 0")
def failed_answers(spark, sf_dir):
    p = _parts(spark, sf_dir).filter("p_partkey % 2 = 0")
    bad = {"qq_music": _ANSWERS["qq_music"].replace('"req_1":{"code":0', '"req_1":{"code":2'), "musixmatch": _ANSWERS["musixmatch"].replace("200", "401"), "netease": "no json", "kugou": "{}"}
    out = p.select("p_partkey", F.lit(0).alias("n"))
    for provider, template in bad.items():
        found = catalogs.candidates(p.select(F.col("p_partkey").alias("query"), _doc(template).alias("body")), provider).select(F.col("query").alias("p_partkey"), F.lit(1).alias("n"))
        out = out.unionByName(found)
    return out.groupBy("p_partkey").agg(F.sum("n").cast("int").alias("n"))


@query(
    "SELECT p_partkey, CASE WHEN c >= 1000 THEN 100 WHEN c >= 950 THEN 99 WHEN c >= 900 THEN 95 WHEN c >= 750 THEN 90 WHEN c >= 600 THEN 70 WHEN c >= 400 THEN 30 WHEN c >= 200 THEN 10 ELSE -1 END AS confidence, "
    "p_brand AS artist, p_name AS track, string_split(p_name, ' ')[-1] AS last_artist, string_split(p_name, ' ')[1] AS last_track, 'Alone' AS lone_track, '' AS lone_artist, "
    "'https://lrclib.net/api/search?track_name=' || replace(p_name, ' ', '+') || '&artist_name=' || replace(p_brand, '#', '%23') AS url, p_name || '词' AS kugou, CAST(NULL AS VARCHAR) AS plain, '[0,10]word(0,10)' AS coded FROM (SELECT *, p_size * 20 AS c FROM part)"
)
def provider_helpers(spark, sf_dir):
    dashed, bare, lone = (catalogs.musixmatch_query(_doc(t)) for t in ("@p_brand@ - @p_name@", "@p_name@", "Alone"))
    return _parts(spark, sf_dir).select(
        "p_partkey", catalogs.confidence_value(F.col("p_size") * 20).alias("confidence"), dashed["artist"].alias("artist"), dashed["track"].alias("track"), bare["artist"].alias("last_artist"), bare["track"].alias("last_track"),
        lone["track"].alias("lone_track"), lone["artist"].alias("lone_artist"), catalogs.lrclib_url(F.col("p_name"), F.col("p_brand")).alias("url"), catalogs.kugou_lyric(F.base64(_doc("@p_name@词").cast("binary"))).alias("kugou"),
        catalogs.qq_lyric(F.col("p_name"), F.lit(0), F.lit(0)).alias("plain"), catalogs.qq_lyric(F.concat(F.lit(_QRC_HEX), F.substring("p_name", 1, 0)), F.lit(0), F.lit(1)).alias("coded"),
    )


_ENCODED = "replace(replace(p_name, ' ', '%20') || '%20' || p_brand, '#', '%23')"


@query(
    "SELECT p_partkey, 'https://music.163.com/api/search/get?s=' || " + _ENCODED + " || '&type=1&limit=10&offset=0' AS netease, 'https://music.163.com/' AS referer, "
    "'https://lrclib.net/api/get?track_name=' || replace(p_name, ' ', '%20') || '&artist_name=' || replace(p_brand, '#', '%23') || '&duration=' || p_size || '.0' AS exact, "
    "'https://lrclib.net/api/search?track_name=' || " + _ENCODED + " AS free, 'https://lrclib.net/api/get/' || p_partkey AS by_id, "
    "'https://apic-desktop.musixmatch.com/ws/1.1/matcher.track.get?app_id=web-desktop-app-v1.0&usertoken=T&q_track=' || replace(p_name, ' ', '%20') || '&q_artist=' || replace(p_brand, '#', '%23') AS matcher, "
    "'POST' AS method, p_name AS asked, 'a=' || replace(p_name, ' ', '+') || '&b=%2F' AS form, 'L' || p_size AS lyric, CAST(NULL AS VARCHAR) AS translated, "
    "'http://lyrics.kugou.com/download?ver=1&client=pc&id=' || p_partkey || '&accesskey=K&fmt=lrc&charset=utf8' AS download FROM part"
)
def provider_requests(spark, sf_dir):
    text_ = _doc("@p_name@ @p_brand@")
    tries = providers.lrclib_track(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_size") * 1000)
    pair = providers.netease_pair(_doc('{"lrc":{"lyric":"L@p_size@"},"tlyric":{}}'))
    qq = providers.qq_music(F.col("p_name"))
    return _parts(spark, sf_dir).select(
        "p_partkey", providers.netease(text_)["url"].alias("netease"), providers.netease(text_)["headers"]["Referer"].alias("referer"), F.get(tries, F.lit(0))["url"].alias("exact"), F.get(tries, F.lit(2))["url"].alias("free"),
        providers.lrclib_by_id(F.col("p_partkey"))["url"].alias("by_id"), providers.musixmatch(_doc("@p_brand@ - @p_name@"), token="T")["url"].alias("matcher"), qq["method"].alias("method"),
        F.get_json_object(qq["body"], "$.req_1.param.query").alias("asked"), providers.form_body({"a": F.col("p_name"), "b": F.lit("/")}).alias("form"), pair["lyric"].alias("lyric"), pair["translated"].alias("translated"),
        providers.kugou_download(_doc('{"candidates":[{"id":"@p_partkey@","accesskey":"K"},{"id":"x","accesskey":"y"}]}'))["url"].alias("download"),
    )
