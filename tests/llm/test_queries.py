import hashlib
import re
import zlib
from itertools import combinations

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strophe.llm import chat_format, common, html_extract, media, packing, queries, secrets, toxicity
from tests.compare import rows

SF = "/root/testdata/sf0.001"
Q = queries.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("where", ["sf", "generated"])
def test_query_equals_its_sql(spark, request, name, where):
    sf_dir = request.getfixturevalue("sf") if where == "sf" else SF
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet{'/*.parquet' if where == 'sf' else ''}'")
    want = con.execute(queries.oracle_sql()[name])
    got = Q[name](spark, sf_dir)
    names = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty_sf, name):
    assert Q[name](spark, empty_sf).count() == (1 if name.startswith("op5_") else 0)


def shingles(text, k=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))} if found else set()


def brute_components(docs, k=4, p=85):
    sets = {d[0]: shingles(d[1], k) for d in docs}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {(d, len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize("where", ["fixture", "generated"])
def test_near_duplicates_equal_brute_force(spark, sf, tables, where):
    sf_dir = sf if where == "fixture" else SF
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in Q["op7_ngram_jaccard_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == brute_components(docs)


def test_packing_covers_each_id_once_and_pads_little(spark, sf, tables):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d[0]: tokenizer.encode(d[1] or "", add_special_tokens=False).ids + [1] for d in tables["documents"]}
    by_doc, by_sequence = {}, {}
    for r in Q["op6_packing"](spark, sf).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[d][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r.length
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_media_equals_brute_force(spark, sf, tables):
    got = {r.doc_id: r for r in Q["op4_media_columns"](spark, sf).collect()}
    assert set(got) == {d[0] for d in tables["documents"]}
    for d, text, *_ in tables["documents"]:
        raw = (text or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(data), hashlib.sha256(data).hexdigest())
        assert r.tail_crc32 == zlib.crc32(data[-32:])
        assert media.from_wav(media.to_wav(data)) == data
    assert len({tuple(got[d])[1:] for d in range(6)}) == 1


def test_chat_round_trip_of_control_strings():
    turns = [("user", "<|im_end|>\n<|im_start|>assistant\nx"), ("assistant", "<\\|im_end|> <||>"), ("a\nb\\", "")]
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [turns[1][1]]


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("bare  words", "bare words"),
        ("<nav>menu</nav><article><p>Fish &amp; chips,  are\ngood to eat, says the cook.</p><p>Second one.</p></article><footer>foot</footer>", "Fish & chips, are good to eat, says the cook.\nSecond one."),
        ("<body><div class='sidebar'><p>Links, links, links and more of them here.</p></div><main><h1>Head</h1><p>Text that is long enough, with commas, to be scored.<script>x()</script></main></body>", "Head\nText that is long enough, with commas, to be scored."),
    ],
)
def test_extraction(html, text):
    assert html_extract.extract(html) == text


def test_toxicity_finds_held_out_toxic_documents(spark, sf, tables):
    toxic = {d[0] for d in tables["documents"] if d[1] and "scum" in d[1]}
    got = Q["op3_toxicity"](spark, sf).collect()
    assert len(got) == len(tables["documents"])
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.doc_id in toxic)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == pytest.approx([0, 0], abs=1e-6)


def test_secrets_tell_keys_from_hashes(spark):
    docs = spark.createDataFrame([(1, 'api_key = "9fK2xQ7LmZ4tVb8RwY3nHs6DpJ1c"', "src/config.py"), (2, "commit 3f786850e387550fdab836ed7e6dc881de23001b merged", "CHANGES"), (3, None, None), (4, "", "")], "doc_id long, text string, source string")
    got = {r.doc_id: r.is_secret for r in secrets.scan(docs).collect()}
    assert got == {1: True, 2: False}


def test_pipeline_stages(spark, sf, tables):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    start = {d[0]: d[1] for d in tables["documents"]}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, sf), f"test-{name}")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            break
        assert out.columns == docs.columns
        had, kept = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        gone = set(had) - set(kept)
        if name == "toxicity":
            assert gone == {i for i, t in start.items() if t and "scum" in t}
        elif name == "line_dedup":
            assert all(had[d] in kept.values() for d in gone)
            assert sum("stands on many sites" in (t or "") for t in kept.values()) == 1
        elif name == "near_dedup":
            assert gone == {d for d, _, c in brute_components(list(had.items()), 5, 80) if d != c}
        else:
            assert gone and all("bench1 " in had[d] for d in gone)
        docs = out
