"""Streams give what tables give; search by levels, with all levels and with a minimum."""

from strophe.operators import search
from strophe.plans import convert
from strophe.streaming import stream


def test_a_stream_converts_as_a_table_does(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.txt").write_text(f"[ti:t{i}]\n[0,10]a{i}(0,10)\n[7000,10]b(7000,10)\n", encoding="utf-8")
    found = stream.text_stream(spark, str(source), 2)
    assert found.isStreaming and stream.parse_stream(found).isStreaming
    done = stream.convert_stream(found, "lrc", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    done.awaitTermination()
    got = {(r.raw_type, r.converted) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    table = spark.read.text(str(source), wholetext=True).withColumnRenamed("value", "text")
    assert got == {(r.raw_type, r.converted) for r in convert.convert(table, "lrc").collect()}
    assert len(got) == 3


CATALOGUE = [
    ("song band", 0, "c0", "song", ["band"], "other album", None, 1000),
    ("song band", 1, "c1", "song", ["band"], "album", None, 1000),
    ("song", 0, "c2", "song", ["somebody"], "album", None, 9000),
    ("lone x y", 0, "c3", "wrong", ["who"], None, None, 1),
]


def _found(spark, **options):
    tracks = [(1, "song (feat. z)", "band", "album", ["band"], None, 1000), (2, "lone", "x", "y", ["x"], None, 1), (3, "none", "no", None, ["no"], None, None)]
    t = spark.createDataFrame(tracks, "track_id int, title string, artist string, album string, artists array<string>, album_artists array<string>, duration_ms int")
    c = spark.createDataFrame(CATALOGUE, "query string, cand_no int, id string, title string, artists array<string>, album string, album_artists array<string>, duration_ms int")
    return t, c


def test_levels_of_a_search(spark):
    t, c = _found(spark)
    first = {(r.track_id, r.place, r.id, r.level) for r in search.search(t, c).collect()}
    # The full text finds nothing for the first track; the second level's answers count, the better album first.
    assert first == {(1, 1, "c1", 1), (1, 2, "c0", 1), (2, 1, "c3", 0)}
    every = {(r.track_id, r.id, r.level) for r in search.search(t, c, full_search=True).collect()}
    assert every == {(1, "c0", 1), (1, "c1", 1), (1, "c2", 2), (2, "c3", 0)}


def test_minimum_of_the_best_match(spark):
    t, c = _found(spark)
    best = {r.track_id: (r.id, r.match_value) for r in search.best(t, c).collect()}
    assert best[1][0] == "c1" and best[1][1] >= 99 and best[2][0] == "c3"
    assert {r.track_id for r in search.best(t, c, minimum=90).collect()} == {1}
