"""Requests against a server of our own: answers, errors, and the order of tries."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from strophe.sources import providers


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def _answer(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        Handler.seen.append((self.command, self.path, self.headers.get("User-Agent"), self.headers.get("Content-Type"), body))
        path = self.path.split("?")[0]
        answers = {
            "/api/search": [] if "free" not in self.path else [{"id": 7, "trackName": "free", "artistName": "a & b", "albumName": "c", "duration": 1.5}],
            "/echo": {"body": body},
        }
        if path in answers:
            data = json.dumps(answers[path]).encode()
            self.send_response(200)
        else:
            data = b"nothing"
            self.send_response(404)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = _answer

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def _here(address):
    """Send to our server instead of the provider's."""
    return lambda r: providers.fetch(r.withField("url", F.regexp_replace(r["url"], "^https?://[^/]+", address)))


def test_search_reads_answers_with_the_adapter(spark, address):
    asked = spark.createDataFrame([("free",), ("free",), ("none",), (None,)], "query string")
    rows = providers.search(asked, "lrclib", transport=_here(address)).collect()
    assert [(r.query, r.title, r.artists, r.duration_ms) for r in rows] == [("free", "free", ["a", "b"], 1500)]
    assert all(agent == providers.AGENT for _, _, agent, _, _ in Handler.seen)


def test_failed_requests_have_no_answer(spark, address):
    urls = [f"{address}/missing", "http://127.0.0.1:1/", "no address", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(providers.fetch(providers.request(F.col("u"))).alias("a"))
    assert [r.a for r in df.collect()] == [None] * 4
    assert providers.search(spark.createDataFrame([("x",)], "query string"), "netease", transport=_here(address)).count() == 0


def test_bodies_are_posted(spark, address):
    json_, form = (providers.request(F.lit(f"{address}/echo"), {"X-Own": "1"}, F.lit(b), form=f) for b, f in (('{"a":1}', False), ("a=1&b=2", True)))
    row = spark.range(1).select(providers.fetch(json_).alias("j"), providers.fetch(form).alias("f")).first()
    assert json.loads(row.j)["body"] == '{"a":1}' and json.loads(row.f)["body"] == "a=1&b=2"
    kinds = {(method, kind) for method, path, _, kind, _ in Handler.seen if path == "/echo"}
    assert kinds == {("POST", "application/json"), ("POST", "application/x-www-form-urlencoded")}


def test_the_first_answer_with_anything_counts(spark, address):
    Handler.seen.clear()
    tries = providers.lrclib_track(F.lit("free text"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    moved = F.transform(tries, lambda r: r.withField("url", F.regexp_replace(r["url"], "^https?://[^/]+", address)))
    answer = spark.range(1).select(providers.fetch_first(moved).alias("a")).first().a
    assert json.loads(answer)[0]["trackName"] == "free"
    # The one track is not found; the search by fields is, so the search by text is not sent.
    assert [path.split("?")[0] for _, path, *_ in Handler.seen] == ["/api/get", "/api/search"]


def test_every_adapter_has_a_searcher():
    from strophe.sources import catalogs

    assert set(providers.SEARCHERS) == set(catalogs.ADAPTERS)
    assert providers.SEARCHERS["netease"].display_name == "Netease Cloud Music"
