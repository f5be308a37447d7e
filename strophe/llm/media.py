"""Media columns with content-defined payload chunking.

A payload (bytes) is stored losslessly as 8-bit mono PCM in a WAV container. The container's bytes are cut by a rolling
gear hash (a cut where the hash of the last 32 bytes has ``MASK`` zero; at least ``MIN_CHUNK``, at most ``MAX_CHUNK``
bytes a chunk), so shared passages give equal chunks wherever they stand. Texts are cut
once, into a list of chunks a document that is written with a row number of its own, so nothing later depends on where
a row stands in a scan. The table of chunks is then deduplicated by digest: first occurrences are found by an
aggregation without the bytes (a digest that a third of all rows share is one row a task), and only they keep their
(compressed) bytes; the ordered chunk list of each document is the rows that bear its number. Reading back joins the
lists of shared chunks with their bytes, puts each document's chunks in order, checks every chunk's digest and the
whole's length, and takes features of the samples.

Bytes move once to be deduplicated and once to be put together, in ``ROUNDS`` slices by digest and by document, so the
shuffle holds a slice of the corpus at a time (what was cut is deleted slice by slice as the store grows); each task first drops the bytes of chunks it has seen in its batch, so a
chunk that a third of all rows share weighs nothing. Only the chunks of one document meet in one row.

Defined results: a null text is an empty payload; an empty payload is all padding; repeated rows are stored as shared
chunks and reported once each; an empty table gives an empty store and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import delete, discard, new_path, only, plan_row, stored, table

UNIT = 576
FILL = 255
RATE = 8000
MIN_CHUNK, MAX_CHUNK = 1 << 10, 1 << 14
#: A cut every 4096 bytes on average, after the least size.
MASK = np.uint32(((1 << 12) - 1) << 20)
WINDOW = 32
ROUNDS = 4


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, filled up to a positive multiple of UNIT."""
    data = (text or "").encode()
    return data + bytes([FILL]) * (max(-(-len(data) // UNIT), 1) * UNIT - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM."""
    body = samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + body


def from_wav(data: bytes) -> bytes:
    """The samples of a WAV file; its chunks may be in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _gear() -> np.ndarray:
    """A code for each byte, from a counter; 256 stands for nothing."""
    out = np.zeros(257, np.uint32)
    out[:256] = [int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4, person=b"gear").digest(), "little") for b in range(256)]
    return out


GEAR = _gear()


def cut_points(items: list[bytes]) -> list[list[int]]:
    """Chunk ends of each item. The hash at a byte is the sum of the last 32 codes, each shifted by its age; it is
    built for a whole batch by doubling, with as many empty codes between items as the window is long."""
    gap = WINDOW - 1
    total = sum(map(len, items)) + gap * len(items)
    h = np.zeros(total, np.uint32)
    at, starts = 0, []
    for x in items:
        at += gap
        starts.append(at)
        h[at : at + len(x)] = GEAR[np.frombuffer(x, np.uint8)]
        at += len(x)
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach].copy() << np.uint32(reach)
        reach *= 2
    found = np.flatnonzero((h & MASK) == 0) + 1
    out = []
    for x, start in zip(items, starts, strict=True):
        lo, hi = np.searchsorted(found, (start, start + len(x)), "right")
        ends, last = [], 0
        for f in (found[lo:hi] - start).tolist():
            while f - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if f - last >= MIN_CHUNK:
                last = f
                ends.append(last)
        while len(x) - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if last < len(x):
            ends.append(len(x))
        out.append(ends)
    return out


def _batches(col: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of a text column of about ``size`` bytes."""
    lengths = np.array([0 if v is None else v for v in pc.binary_length(col.cast(pa.large_string())).to_pylist()], np.int64)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), size, "right")) + at)
        yield at, col.slice(at, to - at).to_pylist()
        at = to


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(rid, doc_id, n_bytes, ord, size, digest, data) of all chunks; ``data`` is null for repetitions within a batch."""
    rows = docs.select(plan_row().alias("rid"), "doc_id", F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("media")
        for batch in batches:
            for at, texts in _batches(batch.column("text")):
                files = [to_wav(payload(t)) for t in texts]
                row, n_bytes, order, size, digests, data = [], [], [], [], [], []
                seen: set[bytes] = set()
                for i, (t, x, ends) in enumerate(zip(texts, files, cut_points(files), strict=True)):
                    a, n = 0, len((t or "").encode())
                    for k, b in enumerate(ends):
                        piece = x[a:b]
                        a = b
                        digest = hashlib.sha256(piece).digest()[:20]
                        row.append(at + i)
                        n_bytes.append(n)
                        order.append(k)
                        size.append(len(piece))
                        digests.append(digest)
                        data.append(None if digest in seen else zlib.compress(piece, 6))
                        seen.add(digest)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rid").take(take), batch.column("doc_id").take(take), pa.array(n_bytes, pa.int64()), pa.array(order, pa.int32()), pa.array(size, pa.int32()), pa.array(digests, pa.binary()), pa.array(data, pa.binary())],
                    ["rid", "doc_id", "n_bytes", "ord", "size", "digest", "data"],
                )

    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n_bytes long, ord int, size int, digest binary, data binary")


def store(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Write the deduplicated chunk table of all documents and return it.

    A row for each chunk of each document; ``data`` stands in one row of each digest, ``shared`` says there are more.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "chunks")
    found = stored(chunks(docs, text).withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(rounds)).cast("int")), "cut", by="part")
    for part in range(rounds):
        rows = spark.read.schema(found.schema).parquet(found._strophe_path).filter(F.col("part") == part).drop("part")
        place = F.struct("rid", "ord")
        first = rows.groupBy("digest").agg(F.min(F.when(F.col("data").isNotNull(), place)).alias("at"), F.count("*").alias("n"))
        keeps = first.select("at.rid", "at.ord", (F.col("n") > 1).alias("shared"))
        # By place, not by digest: no place is hot.
        once = rows.join(keeps.hint("merge"), ["rid", "ord"], "left").withColumns({"data": F.when(F.col("shared").isNotNull(), F.col("data")), "shared": F.coalesce("shared", F.lit(True))})
        out = stored(once, "chunks", f"{path}/part={part}")
        delete(spark, f"{found._strophe_path}/part={part}")
    discard(found)
    out = spark.read.schema(out.schema).parquet(path)
    out._strophe_path = path
    return out


_RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(samples: bytes) -> str:
    """Loudness, peak, zero crossings and duration of 8-bit samples, in whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    sign = x >= 0
    return json.dumps(
        {
            "ms": len(x) * 1000 // RATE,
            "mean_milli": int(x.sum()) * 1000 // len(x),
            "rms_milli": int(np.sqrt((x.astype(np.int64) ** 2).mean()) * 1000),
            "peak": int(np.abs(x).max()),
            "crossings": int((sign[1:] != sign[:-1]).sum()),
        }
    )


def read_back(table_: DataFrame, slice_: Column | None = None) -> DataFrame:
    """Each document's media from its chunk list, verified: (doc_id, n_bytes, payload and media digests, feature)."""
    rows = table_ if slice_ is None else table_.filter(slice_)
    own = rows.filter(F.col("data").isNotNull()).select("rid", "doc_id", "n_bytes", "ord", "size", "digest", "data")
    bytes_ = table_.filter(F.col("shared") & F.col("data").isNotNull()).select("digest", "data")
    other = rows.filter(F.col("data").isNull()).drop("data").join(bytes_, "digest").select(*own.columns)
    lists = own.unionByName(other).groupBy("rid", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("ord", "size", "digest", "data"))).alias("list"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("media")
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                cols: list[list] = [[] for _ in range(6)]
                for pieces in part.column("list").to_pylist():
                    whole = []
                    for k, p in enumerate(pieces):
                        data = zlib.decompress(p["data"])
                        if p["ord"] != k or len(data) != p["size"] or hashlib.sha256(data).digest()[:20] != p["digest"]:
                            raise ValueError("a chunk is missing or damaged")
                        whole.append(data)
                    media = b"".join(whole)
                    samples = from_wav(media)
                    values = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(samples))
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", *(f.split()[0] for f in _RESULT.split(", "))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return lists.mapInArrow(run, f"doc_id {kind}, {_RESULT}")


def digests(docs: DataFrame, text: str = "text", doc: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """Store all texts as media, read them back and report them; the chunk table goes when the report is there."""
    chunk_table = store(docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", rounds)
    out = None
    for part in range(rounds):
        done = stored(read_back(chunk_table, F.pmod(F.xxhash64("rid"), F.lit(rounds)) == part), "media-report")
        out = done if out is None else out.unionByName(done)
    discard(chunk_table)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def brute(text: str | None) -> tuple:
    """What the query returns for one text, without chunks or tables."""
    data = payload(text)
    wav = to_wav(data)
    return (len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), features(data))
