"""N-gram Jaccard join by parity sketches.

Each document is the set of its distinct k-word shingles. A shingle flips one bit of a wide bit sketch, so the Hamming
distance of two sketches is at most the symmetric difference of the sets. Two sets of sizes a and b with Jaccard
similarity t or more differ in at most D = (1 - t) / (1 + t) * (a + b) shingles. The sketch is cut into blocks; a block
is kept as the XOR of a 64-bit code for each flipped bit (equal codes: equal blocks). In each band of set sizes there
are more blocks than D, so by the pigeonhole a similar pair has equal blocks, and the band joins on them:

* bands are [s, 1.5 s); pairs across a band's edge meet in a band of their own around it;
* with D + 1 + e blocks a similar pair shares at least 1 + e of them. A document with at most e empty blocks need not
  publish those (another block of the pair is equal, too); one with more publishes them all. So no link is lost and
  empty blocks gather no crowds.

Documents with equal sets are one class from the start and travel as one signature. What a block bucket needs is its
connected components, not all its pairs. First each class is compared with the most connected class of its buckets,
which leaves one component of most groups of copies. In buckets that still hold several components, members are then
compared in tiles of ``TILE`` by a parity sketch of ``SKETCH`` bits: what is left of the pairs is named, for each two
components the nearest first, until no pair is unnamed that could still join two components, so the components are
exact. Candidates are verified on the full shingle sets of the texts. That is what ``dedup`` needs. ``with_links``, the
query, besides counts every link: links lie inside components, so the classes of each component are compared once, in
blocks of two tiles whose sets are at hand, by parity sketch first and then exactly. A block gives one number for each
of its classes, so rows grow with the classes and not with their pairs (``links`` gives the pairs themselves).

Nothing is collected to the driver but counts. Shingle hashes have 64 bits. Rows are known by a hash of doc_id and text,
never by their place in a scan.

Defined results: null, empty and blank texts have the empty set and link with nothing; with fewer than k words the
whole sequence is the one shingle; repeated rows link as copies; extra columns stay with their rows. ``dedup`` keeps one
of several rows that are equal in doc_id and text (any of them where further columns differ).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import content_key, discard, only, session_conf, stored, table
from strophe.llm.components import components
from strophe.llm.wordhash import mix, shingle_sets

WORDS = 5
#: Similarity as a fraction: the default for near duplicates.
SIMILARITY = (80, 100)
#: Signatures a task remembers so as to publish a class once.
SEEN = 500_000
SLICE = 500
#: Parity bits compared before texts are.
SKETCH = 1024
#: Classes of a bucket or component that are compared as one block with another such block.
TILE = 256
#: Shingles of a tile when links are counted, about, and pairs of a block that are verified one by one.
TILE_SHINGLES = 1 << 16
FEW = 2000
#: Pairs of two components a block may name in each round; the last is all of them.
QUOTAS = (1, 64, TILE * TILE)


@cache
def bands(p: int, q: int, top: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(low, high, D, blocks) of each band of set sizes [low, high): the plain ones and those around their edges."""
    out = []

    def add(low: int, high: int, most: int) -> None:
        d = (q - p) * most // (q + p)  # |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)
        if d:  # else only equal sets are similar
            out.append((low, high, d, d + 2 + (d + 1) // 16))

    low = 1
    while low < top:
        high = max(low + 1, -(-low * 3 // 2))
        add(low, high, 2 * (high - 1))
        small, big = -(-high * p // q), (high - 1) * q // p  # smaller sets below the edge, larger from it on
        add(small, big + 1, high - 1 + big)
        low = high
    return out


def _of_size(n: int, p: int, q: int) -> list[tuple[int, int, int]]:
    """(band, D, blocks) of the bands that hold sets of n shingles."""
    return [(i, d, m) for i, (low, high, d, m) in enumerate(bands(p, q)) if low <= n < high]


def signature(u: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(u ^ np.uint64(0x2545F4914F6CDD1D)))
        return int(mix(np.array([total + np.uint64(len(u)) * np.uint64(0x9E3779B97F4A7C15)]))[0].view(np.int64))


def block_keys(u: np.ndarray, sizes: dict[int, list], p: int, q: int) -> np.ndarray:
    """Keys of the blocks a set publishes; ``u`` is sorted, so each block is a stretch of it."""
    n, out = len(u), []
    found = sizes.get(n)
    if found is None:
        found = sizes[n] = _of_size(n, p, q)
    codes = mix(u ^ np.uint64(0xA0761D6478BD642F))
    prefix = np.zeros(n + 1, np.uint64)
    np.bitwise_xor.accumulate(codes, out=prefix[1:])
    for band, d, m in found:
        cuts = np.arange(m + 1, dtype=np.float64) * (2.0**64 / m)
        at = np.searchsorted(u, cuts[1:m].astype(np.uint64))
        at = np.concatenate(([0], at, [n]))
        words = prefix[at[1:]] ^ prefix[at[:-1]]
        empty = at[1:] == at[:-1]
        ids = np.arange(m, dtype=np.uint64) + np.uint64(band << 40)
        keys = mix(words ^ mix(ids))
        out.append(keys if int(empty.sum()) >= m - d else keys[~empty])
    return np.concatenate(out) if out else codes[:0]


def _rid(docs: DataFrame, text: str, doc: str = "doc_id"):
    return content_key(docs[f"`{doc}`"], docs[f"`{text}`"]).alias("rid")


def describe(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(rid, doc_id, n, sig) for each row; sig is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = list(shingle_sets(part.column("text"), k))
                sig = pa.array([signature(u) if len(u) else None for u in sets], pa.int64())
                n = pa.array([len(u) for u in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), n, sig], ["rid", "doc_id", "n", "sig"])

    rows = docs.select(_rid(docs, text), "doc_id", F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid binary, doc_id {kind}, n long, sig long")


def publish(docs: DataFrame, k: int, p: int, q: int, text: str = "text") -> DataFrame:
    """(key, sig) for each block of each class, about once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        seen: set[int] = set()
        sizes: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                keys, sigs, counts = [], [], []
                for u in shingle_sets(batch.column(0).slice(at, SLICE), k):
                    if len(u) and (sig := signature(u)) not in seen:
                        if len(seen) < SEEN:
                            seen.add(sig)
                        keys.append(block_keys(u, sizes, p, q))
                        sigs.append(sig)
                        counts.append(len(keys[-1]))
                if keys:
                    out = np.repeat(np.array(sigs, np.int64), counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(out)], ["key", "sig"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, sig long")


def verify(pairs: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """The pairs (a, ta, b, tb) whose texts' sets are similar: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(sigs: list[int], texts: pa.Array) -> list[np.ndarray]:
            new = list({s: i for i, s in enumerate(sigs) if s not in known}.items())
            if new:
                made = shingle_sets(texts.take(pa.array([i for _, i in new])), k)
                known.update((s, u) for (s, _), u in zip(new, made, strict=True))
            return [known[s] for s in sigs]

        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                good = []
                for x, y in zip(sets(a, part.column("ta")), sets(b, part.column("tb")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(q * both >= p * (len(x) + len(y) - both))
                while len(known) > 400:
                    known.popitem(last=False)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "ta", "b", "tb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(sig, n, text) of the classes that share a block with another, from one row of each. ``wanted``: sig, n, rid."""
    rows = docs.select(_rid(docs, text), F.col(text).alias("text"))
    return rows.join(wanted, "rid").groupBy("rid", "sig", "n").agg(F.first("text").alias("text")).drop("rid")


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(sig, sketch): SKETCH parity bits of each class; each shingle flips one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                bits = [np.bincount((mix(u) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1 for u in shingle_sets(part.column("text"), k)]
                packed = [np.packbits(b.astype(np.uint8)).tobytes() for b in bits]
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array(packed, pa.binary())], ["sig", "sketch"])

    return texts.select("sig", "text").mapInArrow(run, "sig long, sketch binary")


def _near(tiles: DataFrame, p: int, q: int, quota: int) -> DataFrame:
    """Pairs (a, b) across two tiles of a bucket (``y`` is null: within one) that may be similar by size and by the Hamming distance of their
    sketches and lie in different components: of each two components the ``quota`` nearest."""

    def tile(rows: list[dict]) -> tuple[np.ndarray, ...]:
        sig = np.array([r["sig"] for r in rows], np.int64)
        n = np.array([r["n"] for r in rows], np.int64)
        label = np.array([r["label"] for r in rows], np.int64)
        return sig, n, label, np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint64).reshape(len(rows), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for batch in batches:
            for i in range(batch.num_rows):
                sa, na, la, xa = tile(batch.column("x")[i].as_py())
                y, same = batch.column("y")[i].as_py(), False
                if y is None:
                    sb, nb, lb, xb, same = sa, na, la, xa, True
                else:
                    sb, nb, lb, xb = tile(y)
                ok = (la[:, None] != lb) & (q * np.minimum(na[:, None], nb) >= p * np.maximum(na[:, None], nb))
                if same:
                    ok &= sa[:, None] < sb
                ia, ib = np.nonzero(ok)
                away = np.zeros(len(ia), np.int64)
                for w in range(xa.shape[1]):
                    away += np.bitwise_count(xa[ia, w] ^ xb[ib, w])
                good = away <= (q - p) * (na[ia] + nb[ib]) // (q + p)
                ia, ib, away = ia[good], ib[good], away[good]
                if len(ia):
                    lo, hi = np.minimum(la[ia], lb[ib]), np.maximum(la[ia], lb[ib])
                    order = np.lexsort((away, hi, lo))
                    ia, ib, lo, hi = ia[order], ib[order], lo[order], hi[order]
                    first = np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
                    place = np.arange(len(ia)) - np.maximum.accumulate(np.where(first, np.arange(len(ia)), 0))
                    ia, ib = ia[place < quota], ib[place < quota]
                a, b = sa[ia], sb[ib]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, p: int, q: int) -> DataFrame:
    ta = texts.select(F.col("sig").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("sig").alias("b"), F.col("text").alias("tb"))
    return stored(verify(pairs.join(ta, "a").join(tb, "b"), k, p, q), "links")


def _blocks(members: DataFrame, group: str, member) -> DataFrame:
    """(x, y) for each two tiles of each group, y null for a tile with itself. ``members``: group, sig, tiles (how many
    tiles the group has). Groups of one tile, nearly all, are not dealt out again; the pairs of others are spread."""
    tiles = members.groupBy(group, "tiles", F.pmod(F.xxhash64("sig"), F.col("tiles")).alias("tile")).agg(F.collect_list(member).alias("x"))
    # The members may lie by group; they are dealt out by tile, too, so that no task gets all of a large group.
    with session_conf(members.sparkSession, {"spark.sql.requireAllClusterKeysForDistribution": "true"}):
        tiles = stored(tiles, "tiles")
    none = F.lit(None).cast(tiles.schema["x"].dataType)
    one = tiles.filter("tiles = 1").select("x", none.alias("y"))
    each = tiles.filter("tiles > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sides = each.groupBy(group, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).agg(
        F.first(F.when(F.col("tile") <= F.col("other"), F.col("x")), True).alias("x"), F.first(F.when(F.col("tile") > F.col("other"), F.col("x")), True).alias("y")
    )
    # A tile may be empty; its pairs with others then have one side.
    return one.unionByName(sides.filter((F.col("x").isNotNull()) & ((F.col("i") == F.col("j")) | F.col("y").isNotNull())).select("x", "y"))


def _tile_pairs(members: DataFrame, p: int, q: int, quota: int) -> DataFrame:
    """What ``_near`` names of the members (key, size, sig, n, label, sketch)."""
    members = members.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("long"))
    with session_conf(members.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "50"}):
        return stored(_near(_blocks(members, "key", F.struct("sig", "n", "label", "sketch")), p, q, quota), "near")


def _classes_linked(docs: DataFrame, stats: DataFrame, k: int, p: int, q: int, text: str) -> tuple[DataFrame, DataFrame]:
    """(sig, label) of every class that links with another, and (sig, n, text) of the classes compared."""
    bucket = Window.partitionBy("key")
    found = (
        publish(docs, k, p, q, text)
        .withColumns({"lo": F.min("sig").over(bucket), "hi": F.max("sig").over(bucket)})
        .filter(F.col("lo") != F.col("hi"))
        .select("key", "sig")
        .distinct()
    )
    found = stored(found, "buckets")
    sizes = stored(found.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("sig").cast("decimal(38,0)")).alias("sum")), "sizes")
    one = stats.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min("rid").alias("rid"), F.first("n").alias("n"))
    popular = stored(found.join(sizes.select("key", "size"), "key").groupBy("sig").agg(F.sum("size").alias("pop")).join(one, "sig"), "popular")
    texts = stored(_texts(docs, popular.select("sig", "n", "rid"), text), "class-texts")
    # Buckets of the same members are one: the rest of them adds no pair.
    kept = stored(sizes.groupBy("sum", "size").agg(F.min("key").alias("key")).select("key", "size"), "kept")
    ranked = stored(found.join(kept, "key").join(popular.select("sig", "n", "pop"), "sig").select("key", "sig", "n", "size", "pop"), "ranked")
    discard(found, sizes, kept, popular)

    # First round: each bucket's most connected class against all others.
    hubs = stored(ranked.groupBy("key").agg(F.max(F.struct("pop", "sig", "n")).alias("hub")).select("key", F.col("hub.sig").alias("a"), F.col("hub.n").alias("na")), "hubs")
    pairs = ranked.join(hubs, "key").filter(F.col("a") != F.col("sig")).filter(q * F.least("n", "na") >= p * F.greatest("n", "na"))
    tested = stored(pairs.select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct(), "pairs")
    links = _verified(tested, texts, k, p, q)
    label = components(links)

    # Further rounds: in the buckets that still hold several components, pairs of members by their sketches.
    more = stored(ranked.filter("size > 2").join(sketches(texts, k), "sig"), "sketched")
    discard(hubs, ranked)
    for quota in QUOTAS:
        now = more.join(label.withColumnRenamed("label", "l"), "sig", "left").withColumn("label", F.coalesce("l", "sig")).drop("l")
        mixed = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(F.col("lo") != F.col("hi"))
        mixed = stored(mixed.select("key"), "mixed")
        near = _tile_pairs(now.join(mixed, "key", "left_semi"), p, q, quota)
        if near.isEmpty():
            break
        pairs = stored(near.join(tested, ["a", "b"], "left_anti"), "pairs")
        discard(near, mixed)
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        links = links.unionByName(_verified(pairs, texts, k, p, q))
        label = components(links)
    discard(more)
    return label, texts


# --- links ---------------------------------------------------------------------------------------------------------


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, u in enumerate(sets):
        at = np.searchsorted(columns, u)
        at[at == len(columns)] = 0
        out[i, at[columns[at] == u]] = 1
    return out


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SKETCH parity bits, as 1 and -1, for each set."""
    bits = [np.bincount((mix(u) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1 for u in sets]
    return (1 - 2 * np.array(bits, np.int8)).astype(np.float32)


def similar(x: list[np.ndarray], y: list[np.ndarray] | None, p: int, q: int) -> np.ndarray:
    """Which sets of ``x`` and ``y`` (null: of x above its diagonal) have a similarity of p / q or more."""
    own = y is None
    y = x if own else y
    a, b = np.array([len(u) for u in x]), np.array([len(u) for u in y])
    ok = q * np.minimum(a[:, None], b) >= p * np.maximum(a[:, None], b)
    if own:
        ok &= np.triu(np.ones_like(ok), 1)
    if ok.sum() > 8:
        px = _parities(x)
        away = (SKETCH - px @ (px if own else _parities(y)).T) / 2
        ok &= away <= (q - p) * (a[:, None] + b) // (q + p)
    if ok.sum() <= FEW:
        for i, j in zip(*np.nonzero(ok), strict=True):
            both = len(np.intersect1d(x[i], y[j], assume_unique=True))
            ok[i, j] = q * both >= p * (a[i] + b[j] - both)
        return ok
    values, seen = np.unique(np.concatenate(x), return_counts=True)
    values = values[seen > 1] if own else np.intersect1d(values, np.unique(np.concatenate(y)), assume_unique=True)
    both = np.zeros(ok.shape, np.float32)
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        m = _incidence(x, part)
        both += m @ (m if own else _incidence(y, part)).T
    both = both.astype(np.int64)
    return ok & (q * both >= p * (a[:, None] + b - both))


def _compared(label: DataFrame, texts: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """Blocks of two tiles of the classes (sig, copies, u: the bytes of its set) of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = pa.array([u.tobytes() for u in shingle_sets(part.column("text"), k)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "sig", "copies", "tiles")), sets], ["label", "sig", "copies", "tiles", "u"])

    copies = stats.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.count("*").alias("copies"), F.first("n").alias("n"))
    members = stored(label.join(copies, "sig"), "members")
    tiles = F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE)).cast("long")
    sized = stored(members.groupBy("label").agg(tiles.alias("tiles")), "component-sizes")
    rows = members.join(sized, "label").join(texts.select("sig", "text"), "sig").select("label", "sig", "copies", "tiles", "text")
    return _blocks(rows.mapInArrow(run, "label long, sig long, copies long, tiles long, u binary"), "label", F.struct("sig", "copies", "u"))


def _over_blocks(blocks: DataFrame, p: int, q: int, pairs: bool) -> DataFrame:
    """(a, b): the links of the blocks; or (sig, others): of each class, the rows of its partners in a block."""
    names = ["a", "b"] if pairs else ["sig", "others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("ngram_join")
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = batch.column("x")[i].as_py(), batch.column("y")[i].as_py()
                sides = [x] if y is None else [x, y]
                sets = [[np.frombuffer(r["u"], np.uint64) for r in s] for s in sides]
                ok = similar(sets[0], None if y is None else sets[1], p, q)
                sig = [np.array([r["sig"] for r in s], np.int64) for s in sides]
                copies = [np.array([r["copies"] for r in s], np.int64) for s in sides]
                if pairs:
                    ia, ib = np.nonzero(ok)
                    a, b = sig[0][ia], sig[-1][ib]
                    out = np.minimum(a, b), np.maximum(a, b)
                elif y is None:
                    out = sig[0], ok @ copies[0] + ok.T @ copies[0]
                else:
                    out = np.concatenate(sig), np.concatenate((ok @ copies[1], ok.T @ copies[0]))
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in out], names)

    with session_conf(blocks.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}):
        return stored(blocks.mapInArrow(run, ", ".join(f"{n} long" for n in names)), "links" if pairs else "degrees")


#: Tables here grow with the corpus: they are merged at every size, never broadcast.
_MERGED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def _prepared(docs: DataFrame, k: int, text: str, doc: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) and its ``describe``."""
    docs = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return docs, stored(describe(docs, k), "sets")


def links(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(a, b): every similar pair of classes, a < b; and (doc_id, sig): the class of each row with words.

    In a group of n similar classes these are n (n - 1) / 2 rows."""
    p, q = similarity
    docs, stats = _prepared(docs, k, text, doc)
    with session_conf(docs.sparkSession, _MERGED):
        label, texts = _classes_linked(docs, stats, k, p, q, "text")
        found = _over_blocks(_compared(label, texts, stats, k), p, q, True)
    return found, stats.filter(F.col("sig").isNotNull()).select("doc_id", "sig")


def with_components(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, keeper) for each row: the row (or the equal rows) a component keeps."""
    p, q = similarity
    docs, stats = _prepared(docs, k, text, doc)
    with session_conf(docs.sparkSession, _MERGED):
        label, texts = _classes_linked(docs, stats, k, p, q, "text")
    discard(texts)
    return _membership(stats, label, None).drop("n_links")


def with_links(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``with_components`` and ``n_links``: how many other rows each row is similar to, all of them counted."""
    p, q = similarity
    docs, stats = _prepared(docs, k, text, doc)
    with session_conf(docs.sparkSession, _MERGED):
        label, texts = _classes_linked(docs, stats, k, p, q, "text")
        others = _over_blocks(_compared(label, texts, stats, k), p, q, False).groupBy("sig").agg(F.sum("others").alias("others"))
    discard(texts)
    return _membership(stats, label, others)


def _membership(stats: DataFrame, label: DataFrame, others: DataFrame | None) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, keeper, n_links) for each row, from the labels of linked classes."""
    classes = stats.filter(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.count("*").alias("copies"))
    classes = classes.join(label, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    if others is not None:
        classes = classes.join(others, "sig", "left")
    n_links = F.col("copies") - 1 + (F.coalesce("others", F.lit(0)) if others is not None else 0)
    lowest = classes.groupBy("label").agg(F.min("first").alias("lowest"))
    by_sig = classes.join(lowest, "label").select("sig", "lowest", n_links.cast("long").alias("n_links"))
    linked = stats.filter(F.col("sig").isNotNull()).join(by_sig, "sig")
    alone = stats.filter(F.col("sig").isNull()).withColumns({"lowest": F.struct("doc_id", "rid"), "n_links": F.lit(0).cast("long")})
    return linked.unionByName(alone).select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), F.col("lowest.doc_id").alias("component_id"), (F.col("lowest.rid") == F.col("rid")).alias("keeper"), "n_links"
    )


def dedup(docs: DataFrame, k: int = WORDS, similarity: tuple[int, int] = SIMILARITY, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """One row of each component, unchanged (that of the lowest doc_id); rows without words all stay."""
    found = with_components(docs, k, similarity, text, doc).filter(F.col("keeper") & (F.col("n_shingles") > 0)).select("rid").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _rid(docs, text, doc), F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]").alias("has_words"))
    once = whole.filter("has_words").join(found, "rid", "left_semi").groupBy("rid").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(whole.filter(~F.coalesce("has_words", F.lit(False))).select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return with_links(docs, 4, (85, 100)).select("doc_id", "n_shingles", "component_id", "n_links")
