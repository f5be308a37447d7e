"""Queries of the engine over the driver's tables, each with DuckDB SQL for the same rows.

The tables hold no timed text, so tracks are made of them: a user's events are the lines of a track, an order's items
the syllables of a line, parts are the songs of a catalogue, conversations have turns in the foreground and background.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strophe.functions import match, model, text
from strophe.operators import clean, detect, retime, search
from strophe.plans import convert, generate
from strophe.schemas import LINE, SYLLABLE, explode_lines
from strophe.sources import catalogs, containers, headers, json_dialects, lrc, syllabic, ttml

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strophe import examples  # noqa: F401  registers further queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def _gathered(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """An array of values for each key, in order: what one document holds."""
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(F.struct(*order).alias("_k"), value.alias("_v"))).alias("_a"))
    # Values may hold maps, which have no order: the key alone is compared.
    rows = rows.withColumn("_a", F.array_sort("_a", lambda a, b: F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0)))
    return rows.select(*keys, F.transform("_a", lambda x: x["_v"]).alias(out))


# --- tracks --------------------------------------------------------------------------------------------------------

_SECOND = "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'2020-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) % 4000000 AS INT)"


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, lines): an event is a line of one second (taken as milliseconds)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.expr(_SECOND).alias("start"))
    value = model.line(F.col("event_type"), F.col("start"), F.col("start") + 1000)
    return _gathered(e, ["user_id"], ["start", "event_id"], value, "lines")


_EVENTS_SQL = """e AS (
  SELECT user_id, event_id, event_type, s, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nxt,
         row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn
  FROM (SELECT *, CAST(date_diff('second', TIMESTAMP '2020-01-01', ts) - (date_diff('second', TIMESTAMP '2020-01-01', ts) // 4000000) * 4000000 AS INTEGER) AS s FROM events)),
w AS (SELECT *, s + 1000 > 0 AND coalesce(nxt - (s + 1000) > 5000, true) AS ends FROM e),
t AS (SELECT *, printf('%02d:%02d.%03d', s // 60000, s % 60000 // 1000, s % 1000) AS a,
             printf('%02d:%02d.%03d', (s + 1000) // 60000, (s + 1000) % 60000 // 1000, (s + 1000) % 1000) AS z FROM w)"""


@query(f"WITH {_EVENTS_SQL} SELECT user_id, string_agg('[' || a || ']' || event_type || chr(10) || CASE WHEN ends THEN '[' || z || ']' || chr(10) ELSE '' END, '' ORDER BY s, event_id) AS lrc FROM t GROUP BY user_id")
def lrc_generate(spark, sf_dir):
    return user_tracks(spark, sf_dir).select("user_id", generate.lrc(F.col("lines")).alias("lrc"))


@query(f"""WITH {_EVENTS_SQL}, r AS (
  SELECT user_id, s AS start_ms, event_type AS text, rn * 2 AS k FROM t UNION ALL SELECT user_id, s + 1000, '', rn * 2 + 1 FROM t WHERE ends)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_ms, k) - 1 AS INTEGER) AS line_no, start_ms, text FROM r""")
def lrc_parse(spark, sf_dir):
    made = lrc_generate(spark, sf_dir).select("user_id", lrc.parse(F.col("lrc"))["lines"].alias("lines"))
    return explode_lines(made).select("user_id", "line_no", "start_ms", "text")


@query(f"WITH {_EVENTS_SQL} SELECT user_id, count(*) AS n_lines, true AS same FROM t GROUP BY user_id")
def lrc_roundtrip(spark, sf_dir):
    once = user_tracks(spark, sf_dir).select("user_id", generate.lrc(F.col("lines"), end_times="none").alias("once"))
    again = once.select("user_id", "once", lrc.parse_lines(F.col("once")).alias("lines"))
    return again.select("user_id", F.size("lines").cast("long").alias("n_lines"), (generate.lrc(F.col("lines"), end_times="none") == F.col("once")).alias("same"))


@query(f"WITH {_EVENTS_SQL} SELECT user_id, event_id, ends FROM t")
def huge_end_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_SECOND).alias("start"))
    value = model.line(F.col("event_id").cast("string"), F.col("start"), F.col("start") + 1000)
    tracks = _gathered(e, ["user_id"], ["start", "event_id"], value, "lines")
    ends = F.transform("lines", lambda x, i: F.struct(x["text"].cast("long").alias("event_id"), generate.add_end(model.end_of(x), F.col("lines"), i, "huge").alias("ends")))
    return tracks.select("user_id", F.explode(ends).alias("x")).select("user_id", "x.*")


@query("SELECT event_id, printf('%02d:%02d.%03d', ms // 60000, ms % 60000 // 1000, ms % 1000) AS stamp FROM (SELECT event_id, date_diff('millisecond', date_trunc('hour', ts), ts) AS ms FROM events)")
def format_time(spark, sf_dir):
    ms = F.expr("CAST(timestampdiff(MILLISECOND, date_trunc('HOUR', ts), ts) AS INT)")
    return table(spark, sf_dir, "events").select("event_id", text.timestamp(ms).alias("stamp"))


@query(f"WITH {_EVENTS_SQL} SELECT user_id, CAST(rn - 1 AS INTEGER) AS line_no, s - 250 AS start_ms, s + 750 AS end_ms FROM t")
def offset_shift(spark, sf_dir):
    moved = user_tracks(spark, sf_dir).select("user_id", retime.shift_lines(F.col("lines"), F.lit(250)).alias("lines"))
    return explode_lines(moved).select("user_id", "line_no", "start_ms", "end_ms")


@query("SELECT user_id, CASE WHEN l AND y THEN 'MixedSynced' WHEN l THEN 'LineSynced' WHEN y THEN 'SyllableSynced' ELSE 'Unknown' END AS sync_type FROM (SELECT user_id, bool_or(event_type = 'click') AS l, bool_or(event_type = 'purchase') AS y FROM events GROUP BY user_id)")
def sync_type(spark, sf_dir):
    """Clicks are plain paragraphs, purchases timed spans, all else is left out by the parser."""
    e = table(spark, sf_dir, "events")
    p = F.when(F.col("event_type") == "click", '<p begin="1" end="2">x</p>').when(F.col("event_type") == "purchase", '<p><span begin="1" end="2">x</span></p>').otherwise("<p>x</p>")
    docs = e.groupBy("user_id").agg(F.array_join(F.collect_list(p), "").alias("body"))
    text_ = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml"><body><div>'), "body", F.lit("</div></body></tt>"))
    return docs.select("user_id", ttml.parse(text_).alias("d")).select("user_id", F.col("d.sync_type").alias("sync_type"))


# --- orders as lines of syllables ----------------------------------------------------------------------------------

_I = """i AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber AS txt, l_linenumber * 1000 AS s, CAST(l_quantity AS INTEGER) * 10 AS d,
  min(l_linenumber) OVER (PARTITION BY l_orderkey) * 1000 AS first FROM lineitem)"""
_HEAD = "'[' || any_value(first) || ',' || (last(s + d ORDER BY l_linenumber, txt, d) - any_value(first)) || ']'"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, lines): one line whose syllables are the order's items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("t"), (F.col("l_linenumber") * 1000).alias("s"), (F.col("l_quantity").cast("int") * 10).alias("d"))
    value = F.struct(F.col("t").alias("text"), F.col("s").alias("start_ms"), (F.col("s") + F.col("d")).alias("end_ms")).cast(SYLLABLE)
    found = _gathered(items, ["l_orderkey"], ["l_linenumber", "t", "d"], value, "syllables")
    return found.select("l_orderkey", F.array(model.syllable_line(F.col("syllables"), "Left")).cast(f"array<{LINE}>").alias("lines"))


def _generated(name: str, head: str, one: str, between: str = "") -> None:
    def run(spark, sf_dir, writer=generate.WRITERS[name]):
        return order_lines(spark, sf_dir).select("l_orderkey", writer(F.col("lines")).alias("made"))

    _QUERIES[f"{name}_generate"] = run
    _SQL[f"{name}_generate"] = f"WITH {_I} SELECT l_orderkey, {head} || string_agg({one}, '{between}' ORDER BY l_linenumber, txt, d) || chr(10) AS made FROM i GROUP BY l_orderkey"


def _parsed(name: str, parser: Callable[[Column], Column], writer: Callable[[Column], Column]) -> None:
    def run(spark, sf_dir):
        made = order_lines(spark, sf_dir).select("l_orderkey", parser(writer(F.col("lines")))["lines"].alias("lines"))
        return made.select("l_orderkey", F.posexplode(F.get("lines", F.lit(0))["syllables"]).alias("syllable_no", "x")).select("l_orderkey", "syllable_no", "x.*")

    _QUERIES[f"{name}_parse"] = run
    _SQL[f"{name}_parse"] = f"WITH {_I} SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, txt, d) - 1 AS INTEGER) AS syllable_no, txt AS text, s AS start_ms, s + d AS end_ms FROM i"


_generated("qrc", _HEAD, "txt || '(' || s || ',' || d || ')'")
_generated("krc", _HEAD, "'<' || (s - first) || ',' || d || ',0>' || txt", ",0>")
_generated("yrc", _HEAD, "'(' || s || ',' || d || ',0)' || txt")
_generated("syllable", "'[4]'", "txt || '(' || s || ',' || d || ')'")
_generated("lines", "'[' || any_value(first) || ',' || last(s + d ORDER BY l_linenumber, txt, d) || ']'", "txt")
_parsed("qrc", syllabic.parse_qrc, generate.qrc)
_parsed("krc", syllabic.parse_krc, lambda x: generate.krc(x, canonical=True))
_parsed("yrc", syllabic.parse_yrc, generate.yrc)
_parsed("syllable", syllabic.parse_syllable, generate.syllable)


@query(f"WITH {_I} SELECT l_orderkey, string_agg(txt, '' ORDER BY l_linenumber, txt, d) AS text, any_value(first) AS start_ms, last(s + d ORDER BY l_linenumber, txt, d) AS end_ms FROM i GROUP BY l_orderkey")
def lines_parse(spark, sf_dir):
    made = order_lines(spark, sf_dir).select("l_orderkey", syllabic.parse_lines(generate.lines_dialect(F.col("lines")))["lines"].alias("lines"))
    return explode_lines(made).select("l_orderkey", "text", "start_ms", "end_ms")


@query(f"WITH {_I} SELECT l_orderkey, string_agg(txt, '' ORDER BY l_linenumber, txt, d) AS text, any_value(first) AS start_ms, last(s + d ORDER BY l_linenumber, txt, d) AS end_ms, 'Left' AS alignment FROM i GROUP BY l_orderkey")
def downgrade_sync(spark, sf_dir):
    down = order_lines(spark, sf_dir).select("l_orderkey", clean.to_line_synced(F.col("lines")).alias("lines"))
    return explode_lines(down).select("l_orderkey", "text", "start_ms", "end_ms", "alignment")


@query(f"WITH {_I} SELECT l_orderkey, printf('%02d:%02d.%03d', min(s) // 60000, min(s) % 60000 // 1000, min(s) % 1000) AS a, 'ends ' || count(*) AS b FROM i GROUP BY l_orderkey")
def convert_qrc_to_lrc(spark, sf_dir):
    qrc = order_lines(spark, sf_dir).select("l_orderkey", F.size(F.get("lines", F.lit(0))["syllables"]).alias("n"), generate.qrc(F.col("lines")).alias("text"))
    out = convert.convert(qrc, "lrc", dialect="qrc")
    return out.select("l_orderkey", F.regexp_extract("converted", r"^\[([^\]]*)\]", 1).alias("a"), F.concat(F.lit("ends "), F.col("n").cast("string")).alias("b"))


@query(f"WITH {_I} SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, txt, d) - 1 AS INTEGER) AS syllable_no, txt AS text, s AS start_ms, s + d AS end_ms FROM i")
def spotify_parse(spark, sf_dir):
    def doc(lines: Column) -> Column:
        x = F.get(lines, F.lit(0))
        parts = F.transform(x["syllables"], lambda s: F.struct(s["start_ms"].cast("string").alias("startTimeMs"), s["end_ms"].cast("string").alias("endTimeMs"), F.char_length(s["text"]).cast("string").alias("numChars")))
        line = F.struct(model.start_of(x).cast("string").alias("startTimeMs"), F.lit("0").alias("endTimeMs"), model.any_text(x).alias("words"), parts.alias("syllables"))
        return F.to_json(F.struct(F.struct(F.lit("SYLLABLE_SYNCED").alias("syncType"), F.array(line).alias("lines"), F.lit("p").alias("provider")).alias("lyrics")))

    made = order_lines(spark, sf_dir).select("l_orderkey", json_dialects.parse_spotify(doc(F.col("lines")))["lines"].alias("lines"))
    return made.select("l_orderkey", F.posexplode(F.get("lines", F.lit(0))["syllables"]).alias("syllable_no", "x")).select("l_orderkey", "syllable_no", "x.*")


@query(f"WITH {_EVENTS_SQL} SELECT user_id, CAST(rn - 1 AS INTEGER) AS line_no, s AS start_ms, event_type AS text FROM t")
def musixmatch_parse(spark, sf_dir):
    body = generate.lrc(F.col("lines"), end_times="none")
    ok = F.struct(F.lit(200).alias("status_code"))
    inner = F.struct(F.array(F.struct(F.struct(body.alias("subtitle_body"), F.lit("en").alias("subtitle_language")).alias("subtitle"))).alias("subtitle_list"))
    calls = F.struct(F.struct(F.struct(ok.alias("header"), inner.alias("body")).alias("message")).alias("track.subtitles.get"))
    doc = F.to_json(F.struct(F.struct(F.struct(calls.alias("macro_calls")).alias("body")).alias("message")))
    made = user_tracks(spark, sf_dir).select("user_id", json_dialects.parse_musixmatch(doc)["lines"].alias("lines"))
    return explode_lines(made).select("user_id", "line_no", "start_ms", "text")


@query(f"WITH {_I} SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, txt, d) - 1 AS INTEGER) AS syllable_no, txt AS text, s AS start_ms, s + d AS end_ms FROM i")
def ttml_parse(spark, sf_dir):
    span = F.transform(F.get("lines", F.lit(0))["syllables"], lambda s: F.format_string('<span begin="%.3f" end="%.3fs">%s</span>', s["start_ms"] / 1000.0, s["end_ms"] / 1000.0, s["text"]))
    doc = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="0" end="9">'), F.array_join(span, ""), F.lit("</p></div></body></tt>"))
    made = order_lines(spark, sf_dir).select("l_orderkey", ttml.parse(doc)["lines"].alias("lines"))
    return made.select("l_orderkey", F.posexplode(F.get("lines", F.lit(0))["syllables"]).alias("syllable_no", "x")).select("l_orderkey", "syllable_no", "x.*")


# --- text, headers, cleaning ---------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, string_split(text, chr(10))[i] AS line FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i)")
def lines_explode(spark, sf_dir):
    lines = F.transform(headers.text_lines(F.col("text")), lambda x: model.line(x)).cast(f"array<{LINE}>")
    return explode_lines(table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))).select("doc_id", "line_no", F.col("text").alias("line"))


# Synthesized texts of all dialects, as expressions that both engines read alike.
_FORMS = [
    "'[00:0' || p_size % 10 || '.500]' || p_name",
    "'[0,' || p_size || ']' || p_name || '(0,' || p_size || ')'",
    "'[ti:x]' || chr(10) || '<0,' || p_size || ',0>' || p_name",
    "'[0,' || p_size || '](0,' || p_size || ',0)' || p_name",
    "'[4]' || p_name || '(0,' || p_size || ')'",
    "'{\"lyrics\":{\"syncType\":\"' || p_name || '\"}}'",
    "'{\"message\":{\"body\":{\"macro_calls\":\"' || p_name || '\"}}}'",
    "'<tt xmlns=\"x\">' || p_name || '</tt>'",
    "'[type:LyricifyLines]' || chr(10) || '[0,' || p_size || ']' || p_name",
    "p_name",
]
FORM = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_FORMS)) + " END"
_TEXTS = f"SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'g' || page_id, html FROM pages UNION ALL SELECT 'p' || p_partkey, {FORM} FROM part"


@query(f"""WITH t AS (SELECT id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM ({_TEXTS})),
l AS (SELECT id, x, len(list_filter(string_split(replace(x, chr(13) || chr(10), chr(10)), chr(10))[1:5], lambda y: starts_with(y, '[') AND contains(y, '](') AND contains(y, ','))) > 0 AS syl FROM t)
SELECT id, CASE WHEN starts_with(x, '{{') AND contains(x, '"') AND (contains(x, 'colorLyrics') OR contains(x, 'lyrics') AND contains(x, 'syncType')) THEN 'spotify'
  WHEN starts_with(x, '{{') AND contains(x, '"') AND contains(x, 'message') AND contains(x, 'macro_calls') THEN 'musixmatch'
  WHEN contains(x, '<tt ') AND contains(x, 'xmlns') THEN 'ttml'
  WHEN contains(x, '[type:LyricifySyllable]') OR syl THEN 'syllable'
  WHEN contains(x, '[type:LyricifyLines]') OR regexp_matches(x, '^\\[[0-9]+,[0-9]+\\]') AND regexp_matches(x, '[\\pL\\pN_]\\([0-9]+,[0-9]+\\)') THEN 'lines'
  WHEN contains(x, '],(') AND contains(x, ',0)') THEN 'yrc' WHEN contains(x, ',0>') THEN 'krc'
  WHEN regexp_matches(x, '\\([0-9]+,[0-9]+\\)') THEN 'qrc' WHEN contains(x, '[') AND contains(x, ']') AND contains(x, ':') THEN 'lrc' ELSE 'unknown' END AS raw_type FROM l""")
def detect_format(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    g = table(spark, sf_dir, "pages").select(F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    p = table(spark, sf_dir, "part").selectExpr("'p' || p_partkey AS id", f"{FORM} AS text")
    return d.unionByName(g).unionByName(p).select("id", detect.detect(F.col("text")).alias("raw_type"))


@query("""SELECT p_partkey, p_name AS title, p_brand AS artist, p_type AS album, p_size * 1000 AS duration_ms, -p_size AS offset_ms, 5 AS n_attributes, 1 AS n_body FROM part""")
def header_attributes(spark, sf_dir):
    doc = "'[ti:' || p_name || ']\n[ar:' || p_brand || ']\n[al:' || p_type || ']\n[length:' || p_size * 1000 || ']\n[offset:-' || p_size || ']\n[0,1]x(0,1)'"
    lines = table(spark, sf_dir, "part").select("p_partkey", headers.text_lines(F.expr(doc)).alias("l"))
    attrs = headers.attributes(F.col("l"))
    meta = headers.header_metadata(attrs)
    return lines.select("p_partkey", meta["title"].alias("title"), meta["artist"].alias("artist"), meta["album"].alias("album"), meta["duration_ms"].alias("duration_ms"), headers.offset(attrs).alias("offset_ms"), F.size(attrs).alias("n_attributes"), F.size(headers.body(F.col("l"))).alias("n_body"))


_DOC_LINES = "x AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n FROM documents, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i))"


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), lambda t: model.line(t)).cast(f"array<{LINE}>").alias("lines"))


def _joined(lines: Column) -> Column:
    return F.md5(F.array_join(F.transform(lines, lambda x: x["text"]), "\n"))


@query(f"WITH {_DOC_LINES} SELECT doc_id, CAST(count(*) FILTER (WHERE k) AS INTEGER) AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k), '')) AS digest FROM (SELECT *, NOT (starts_with(line, 'The') OR starts_with(line, 'Le')) AS k FROM x) GROUP BY doc_id")
def clean_info_lines(spark, sf_dir):
    kept = _document_lines(spark, sf_dir).select("doc_id", clean.drop_info(F.col("lines"), ("The", "Le")).alias("lines"))
    return kept.select("doc_id", F.size("lines").alias("n_lines"), _joined(F.col("lines")).alias("digest"))


@query(f"""WITH {_DOC_LINES}, y AS (SELECT *, CASE WHEN length(line) < 12 THEN '' ELSE line END AS t FROM x),
z AS (SELECT *, min(i) FILTER (WHERE t <> '') OVER (PARTITION BY doc_id) AS a, max(i) FILTER (WHERE t <> '') OVER (PARTITION BY doc_id) AS b FROM y)
SELECT doc_id, CAST(count(*) FILTER (WHERE i BETWEEN a AND b) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE i >= a) AS INTEGER) AS n_after, md5(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE i BETWEEN a AND b), '')) AS digest FROM z GROUP BY doc_id""")
def trim_blank_edges(spark, sf_dir):
    short = _document_lines(spark, sf_dir).select("doc_id", F.transform("lines", lambda x: x.withField("text", F.when(F.char_length(x["text"]) < 12, "").otherwise(x["text"]))).alias("lines"))
    both = clean.trim_blank_edges(F.col("lines"))
    return short.select("doc_id", F.size(both).alias("n_lines"), F.size(clean.drop_leading_blank(F.col("lines"))).alias("n_after"), _joined(both).alias("digest"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE p_name || ' [E]' END AS text, p_partkey % 3 <> 0 AS marked FROM part")
def strip_markers(spark, sf_dir):
    t = F.expr("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '[E][E] ' || p_name ELSE '🅴 ' || p_name || ' [E]' END")
    rows = table(spark, sf_dir, "part").select("p_partkey", t.alias("t"))
    one = F.get(clean.strip_explicit(F.array(model.line(F.col("t"))).cast(f"array<{LINE}>")), F.lit(0))
    return rows.select("p_partkey", one["text"].alias("text"), text.is_explicit(F.col("t")).alias("marked"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
g AS (SELECT *, sum(CASE WHEN role <> 'assistant' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, CAST(island - 1 AS INTEGER) AS line_no, arg_min(role || turn, turn) AS text, CASE WHEN count(*) > 1 THEN arg_max(role || turn, turn) END AS under FROM g GROUP BY conv_id, island""")
def background_merge(spark, sf_dir):
    t = F.concat("role", F.col("turn").cast("string"))
    one = model.syllable_line(F.array(F.struct(t.alias("text"), F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"))).cast(f"array<{SYLLABLE}>"))
    value = F.struct(one.alias("line"), (F.col("role") == "assistant").alias("back"))
    found = _gathered(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], value, "flagged")
    rows = found.select("conv_id", F.posexplode(syllabic.merge_background(F.col("flagged"))).alias("line_no", "x"))
    return rows.select("conv_id", "line_no", model.any_text(F.col("x")).alias("text"), F.when(F.col("x.sub_line").isNotNull(), model.any_text(F.col("x.sub_line"))).alias("under"))


@query("SELECT d.doc_id, least(n_chars, quality * 500) AS lo, greatest(n_chars, quality * 500) AS hi FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def min_max_opt(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 500).cast("long").alias("q")), "doc_id", "left")
    return rows.select("doc_id", text.min_opt(F.col("n_chars"), F.col("q")).alias("lo"), text.max_opt(F.col("n_chars"), F.col("q")).alias("hi"))


@query("""SELECT p_partkey, regexp_matches(CAST(p_size AS VARCHAR), '^[0-9]+$') AS is_num, p_name AS bare, regexp_replace(p_name || '   ' || p_brand, ' +', ' ', 'g') AS spaced,
  CAST(p_size * 1500 AS INTEGER) AS clock, hex(p_name::BLOB) AS hexed, p_size AS inside, 'zh' AS lang FROM part""")
def text_helpers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hexed = F.hex(F.col("p_name").cast("binary"))
    return p.select(
        "p_partkey",
        text.is_number(F.col("p_size").cast("string")).alias("is_num"),
        text.strip_brackets(F.concat(F.lit(" ("), "p_name", F.lit(") "))).alias("bare"),
        text.single_spaces(F.concat("p_name", F.lit("   "), "p_brand")).alias("spaced"),
        text.clock_ms(F.format_string("%.3fs", F.col("p_size") * 1.5)).alias("clock"),
        F.hex(text.hex_bytes(hexed)).alias("hexed"),
        text.to_int(text.between(F.concat(F.lit("a<"), F.col("p_size").cast("string"), F.lit(">b")), "<", ">")).alias("inside"),
        text.language_key(F.lit(" zh-Hans ")).alias("lang"),
    )



# --- containers ----------------------------------------------------------------------------------------------------


def _encoded(encode) -> Callable[[Column], Column]:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([encode(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


@query("SELECT s_suppkey, s_name AS text FROM supplier")
def decrypt_krc(spark, sf_dir):
    import base64

    made = table(spark, sf_dir, "supplier").select("s_suppkey", _encoded(lambda v: base64.b64encode(containers.krc_bytes(v)).decode())(F.col("s_name")).alias("coded"))
    return convert.decode(made, "krc").select("s_suppkey", "text")


@query("SELECT s_suppkey, s_name AS text FROM supplier")
def decrypt_qrc(spark, sf_dir):
    made = table(spark, sf_dir, "supplier").select("s_suppkey", _encoded(containers.qrc_hex)(F.col("s_name")).alias("coded"))
    return convert.decode(made, "qrc").select("s_suppkey", "text")


# --- matching and search -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN a = 0 OR b = 0 OR b IS NULL THEN NULL WHEN abs(a - b) = 0 THEN 'Perfect' WHEN abs(a - b) < 300 THEN 'VeryHigh' WHEN abs(a - b) < 700 THEN 'High'
  WHEN abs(a - b) < 1500 THEN 'Medium' WHEN abs(a - b) < 3500 THEN 'Low' ELSE 'NoMatch' END AS label
FROM (SELECT o_orderkey, a, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey) AS b FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS a FROM orders))""")
def duration_match(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("long").alias("a"))
    pairs = o.withColumn("b", F.lead("a").over(Window.partitionBy("o_custkey").orderBy("a", "o_orderkey")))
    return pairs.select("o_orderkey", match.duration_match(F.col("a"), F.col("b")).alias("label"))


@query("""WITH l AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, lead(string_split(lower(p_name), ' ')) OVER (ORDER BY p_partkey) AS b FROM part),
c AS (SELECT *, len(list_filter(b, lambda v: list_contains(a, v))) AS k, len(a) AS n, len(b) AS m FROM l)
SELECT p_partkey, CASE WHEN b IS NULL THEN NULL WHEN k = n AND n = m THEN 'Perfect' WHEN k + 1 >= n AND n >= 2 THEN 'VeryHigh' WHEN k = 1 AND n = 1 AND m = 2 THEN 'High'
  WHEN n = 1 AND m > 1 AND starts_with(a[1], b[1]) THEN 'High' WHEN n = 1 AND m > 1 AND length(b[1]) > 3 AND contains(a[1], b[1]) THEN 'High'
  WHEN n = 1 AND m > 1 AND length(b[1]) > 1 AND contains(a[1], b[1]) THEN 'Medium' WHEN k = 1 AND n = 1 AND m >= 3 THEN 'Medium' WHEN k >= 2 THEN 'Low' ELSE 'NoMatch' END AS label FROM c""")
def artist_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"))
    # Neighbours by key without a global window: the next key's row is joined.
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(b, "p_partkey", "left").select("p_partkey", match.artist_match(F.col("a"), F.col("b")).alias("label"))


_PAIRS = "n AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON true)"
_LCS = f"""WITH RECURSIVE {_PAIRS}, r AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda z: 0) AS cells FROM p
  UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda cur, j: list_append(cur, CASE WHEN b[j[1]] = a[i + 1] THEN cells[j[1]] + 1 ELSE greatest(cells[j[1] + 1], cur[-1]) END), [0::BIGINT]) FROM r WHERE i < length(a)),
s AS (SELECT a, b, cells[-1] AS lcs FROM r WHERE i = length(a))"""


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct names: those that do not match are results, too, so nothing blocks."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    return n.crossJoin(n.select(F.col("a").alias("b")))


@query(f"{_LCS} SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE lcs * 100.0 / greatest(length(a), length(b)) END::DOUBLE AS similarity FROM s")
def text_similarity(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", text.similarity(F.col("a"), F.col("b")).alias("similarity"))


@query(f"""{_LCS}, q AS (SELECT *, lcs * 100.0 / greatest(length(a), length(b)) AS share,
  len(list_filter(range(1, least(length(a), length(b)) + 1), lambda j: a[j] = b[j])) AS eq FROM s)
SELECT a, b, CASE WHEN a = b THEN 'Perfect' WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 'VeryHigh'
  WHEN length(a) = length(b) AND length(a) >= 4 AND eq / length(a) >= 0.8 THEN 'High'
  WHEN share > 90 THEN 'VeryHigh' WHEN share > 80 THEN 'High' WHEN share > 68 THEN 'Medium' WHEN share > 55 THEN 'Low' ELSE 'NoMatch' END AS label FROM q""")
def name_match(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", match.name_match(F.col("a"), F.col("b")).alias("label"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("track_id"),
        F.concat("p_name", F.expr("CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' (feat. x)' END")).alias("title"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.array("p_brand").alias("artists"),
        F.lit(None).cast("array<string>").alias("album_artists"),
        (F.col("p_size") * 100).alias("duration_ms"),
    )


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, found by title, brand and type, or by title and brand."""
    p = table(spark, sf_dir, "part")
    texts = F.array(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.concat_ws(" ", "p_name", "p_brand"))
    return p.select(
        F.explode(texts).alias("query"), F.col("p_partkey").alias("cand_no"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.array("p_brand").alias("artists"), F.col("p_type").alias("album"), F.lit(None).cast("array<string>").alias("album_artists"), (F.col("p_size") * 100).alias("duration_ms"),
    )


_QUERIES_SQL = """t AS (SELECT p_partkey AS track_id, p_name AS n, p_name || CASE p_partkey % 2 WHEN 0 THEN '' ELSE ' (feat. x)' END AS title, p_brand, p_type, p_size * 100 AS dur FROM part),
q AS (SELECT track_id, 0 AS level, title || ' ' || p_brand || ' ' || p_type AS query FROM t
  UNION ALL SELECT track_id, 1, n || ' ' || p_brand FROM t UNION ALL SELECT track_id, 2, n FROM t)"""


@query(f"WITH {_QUERIES_SQL} SELECT track_id, level, query FROM q")
def refine_queries(spark, sf_dir):
    return search.queries_of(_tracks(spark, sf_dir))


_SEARCH_SQL = f"""WITH {_QUERIES_SQL},
c AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS query, p_name, p_type, p_size * 100 AS dur FROM part UNION ALL SELECT p_partkey, p_name || ' ' || p_brand, p_name, p_type, p_size * 100 FROM part),
f AS (SELECT q.track_id, q.level, c.id, t.title, c.p_name, t.p_type AS ta, c.p_type AS ca, t.dur AS td, c.dur AS cd, min(q.level) OVER (PARTITION BY q.track_id) AS first FROM q JOIN c ON c.query = q.query JOIN t ON t.track_id = q.track_id),
m AS (SELECT *, CASE WHEN title = p_name THEN 7.0 ELSE 6.0 END + 7.0
   + CASE WHEN abs(td - cd) = 0 THEN 7.0 WHEN abs(td - cd) < 300 THEN 6.0 WHEN abs(td - cd) < 700 THEN 5.0 WHEN abs(td - cd) < 1500 THEN 4.0 WHEN abs(td - cd) < 3500 THEN 2.0 ELSE 0.0 END AS base, ta = ca AS same FROM f WHERE level = first)"""


# The album's match by the rules for names without marks, from its common characters.
_ALBUM_SQL = """x AS (SELECT DISTINCT lower(ta) AS a, lower(ca) AS b FROM m WHERE ta <> ca),
r AS (
  SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda z: 0) AS cells FROM x
  UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda cur, j: list_append(cur, CASE WHEN b[j[1]] = a[i + 1] THEN cells[j[1]] + 1 ELSE greatest(cells[j[1] + 1], cur[-1]) END), [0::BIGINT]) FROM r WHERE i < length(a)),
g AS (SELECT a, b, CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 6.0
  WHEN length(a) = length(b) AND length(a) >= 4 AND len(list_filter(range(1, length(a) + 1), lambda j: a[j] = b[j])) / length(a) >= 0.8 THEN 5.0
  WHEN share > 90 THEN 6.0 WHEN share > 80 THEN 5.0 WHEN share > 68 THEN 4.0 WHEN share > 55 THEN 2.0 ELSE 0.0 END AS points
  FROM (SELECT a, b, cells[-1] * 100.0 / greatest(length(a), length(b)) AS share FROM r WHERE i = length(a)))"""


@query(f"""{_SEARCH_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {_ALBUM_SQL}
SELECT track_id, CAST(id AS VARCHAR) AS id, level, CAST((base + 0.4 * CASE WHEN same THEN 7.0 ELSE g.points END) * 30.0 / (30.0 - 0.2 * 7.0) AS DOUBLE) AS score
FROM m LEFT JOIN g ON g.a = lower(ta) AND g.b = lower(ca)""")
def track_score(spark, sf_dir):
    """Every scored pair of the search."""
    return search.search(_tracks(spark, sf_dir), _catalogue(spark, sf_dir)).select("track_id", "id", "level", "score")


@query(f"""{_SEARCH_SQL}, o AS (SELECT track_id, id, row_number() OVER (PARTITION BY track_id ORDER BY CASE WHEN s > 21 THEN 100 WHEN s > 19 THEN 99 WHEN s > 17 THEN 95 WHEN s > 15 THEN 90 ELSE 70 END DESC, id) AS k
  FROM (SELECT *, (base + 2.8) * 30.0 / (30.0 - 0.2 * 7.0) AS s FROM m WHERE same))
SELECT track_id, CAST(id AS VARCHAR) AS id FROM o WHERE k = 1""")
def best_match(spark, sf_dir):
    return search.best(_tracks(spark, sf_dir), _catalogue(spark, sf_dir)).select("track_id", "id")


@query("SELECT 'netease' AS provider, p_name AS query, 0 AS cand_no, CAST(p_partkey AS VARCHAR) AS id, p_partkey AS numeric_id, p_name AS title, p_brand AS artist, p_type AS album, p_size * 1000 AS duration_ms FROM part UNION ALL SELECT 'kugou', p_name, 0, 'h' || p_partkey, NULL, p_name, p_brand || '|x', p_type, p_size * 1000 FROM part")
def catalogue_answers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    names = F.array(F.struct(F.col("p_brand").alias("name")))
    song = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), names.alias("artists"), F.struct(F.col("p_type").alias("name")).alias("album"), (F.col("p_size") * 1000).alias("duration"))
    netease = p.select(F.col("p_name").alias("query"), F.to_json(F.struct(F.struct(F.array(song).alias("songs")).alias("result"))).alias("body"))
    info = F.struct(F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("hash"), F.col("p_name").alias("songname"), F.concat("p_brand", F.lit("、 x,")).alias("singername"), F.col("p_type").alias("album_name"), F.col("p_size").alias("duration"))
    kugou = p.select(F.col("p_name").alias("query"), F.to_json(F.struct(F.struct(F.array(info).alias("info")).alias("data"))).alias("body"))
    both = catalogs.candidates(netease, "netease").unionByName(catalogs.candidates(kugou, "kugou"))
    return both.select("provider", "query", "cand_no", "id", "numeric_id", "title", F.array_join("artists", "|").alias("artist"), "album", "duration_ms")


@query("""SELECT s_suppkey, CASE WHEN c = 1 THEN 'Left' WHEN (k - 1) % 2 = 0 THEN 'Left' ELSE 'Right' END AS alignment
FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier)""")
def agent_alignment(spark, sf_dir):
    """The suppliers of a nation are agents of one kind, each with a paragraph: the parser decides their sides."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    rows = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    agents = F.array_join(F.transform("keys", lambda k: F.concat(F.lit('<ttm:agent type="group" xml:id="v'), k.cast("string"), F.lit('"/>'))), "")
    lines = F.array_join(F.transform("keys", lambda k: F.concat(F.lit('<p begin="1" end="2" ttm:agent="v'), k.cast("string"), F.lit('">'), k.cast("string"), F.lit("</p>"))), "")
    doc = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><head>'), agents, F.lit("</head><body>"), lines, F.lit("</body></tt>"))
    found = rows.select("s_nationkey", ttml.parse(doc)["lines"].alias("lines"))
    return explode_lines(found).select(F.col("text").cast("long").alias("s_suppkey"), "alignment")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the events, written as LRC, detected, parsed and written in the line dialect."""
    made = lrc_generate(spark, sf_dir).withColumnRenamed("lrc", "text")
    parsed = convert.parse(made, dialects=["lrc"])
    written = generate.lrc(F.col("parsed")["lines"], F.col("parsed")["metadata"])
    return parsed.select("user_id", "raw_type", F.col("parsed.sync_type").alias("sync_type"), F.size("parsed.lines").alias("n_lines"), written.alias("lrc"))
