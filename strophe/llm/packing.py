"""Packing by cutting stock with column generation.

Documents are tokenized (ids plus an end id) and cut at multiples of the sequence length; what is counted from there on
is a histogram of piece lengths, at most one row per length however large the corpus. On the driver a linear program
over patterns (how many pieces of which lengths share a sequence) with a row for every length is solved by column
generation. The knapsack dynamic program first prices at the duals of the area bound (a length's share of a sequence):
for the largest length still uncovered, the fullest pattern of lengths still uncovered, used until one of them is
covered. That gives one column a length and a triangular basis, so a vertex of the program. From there on it prices at
the vertex's own duals and the simplex method pivots, until the objective is within ``GAP`` of the better of the area
bound and the Farley bound.

Patterns are then used as often as the program says, rounded down, and once more where half or more was cut off and the
pieces are there. What is left (a few pieces a length, however many documents) is a smaller program, solved the same
way, until a program places less than half of what is left; only that rest is filled by complements and subset sums.

Pieces are ranked within their length (in parts, so a length that holds a third of all pieces is spread), and the rank
says which copy of which pattern takes the piece: sequence and offset follow by arithmetic, from the plan's bounds,
sorted by length and rank. Texts never travel; each piece's row is made where its text is.

Defined results: null and empty texts are the end id alone, one piece; repeated rows are packed once each; an empty
table gives an empty result and no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm.common import WORKER_CACHES, only, plan_row, stored, table

LENGTH = 2048
END_ID = 1
#: Parts a length is ranked in: at least so many, and one for each SALT_ROWS pieces.
SALTS = 64
SALT_ROWS = 2_000_000
#: How far the objective may be above its lower bound.
GAP = 1e-3
_EPS = 1e-9

_ENCODERS: dict = {}
WORKER_CACHES["packing"] = _ENCODERS.clear


def tokenizer_path() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encoder(path: str):
    if path not in _ENCODERS:
        from strophe.llm.bpe import WordBpe

        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(rid, doc_id, start, length, ids_crc32, doc_tokens) for each piece."""
    rows = docs.select(plan_row().alias("rid"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        encode = _encoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, start, size, crc, total = [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    for a in range(0, n, length):
                        x = ids[4 * a : 4 * (a + length)]
                        row.append(i)
                        start.append(a)
                        size.append(len(x) // 4)
                        crc.append(zlib.crc32(x))
                        total.append(n)
                take = pa.array(row, pa.int64())
                cols = [part.column("rid").take(take), part.column("doc_id").take(take), *(pa.array(c, pa.int64()) for c in (start, size, crc, total))]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# --- the plan, from the histogram alone ----------------------------------------------------------------------------


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best unbounded knapsack over sizes (ascending): its value and how many of each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if k:
            v = best[c - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], choice[c] = v[i], i
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            s = int(sizes[choice[c]])
            out[s] = out.get(s, 0) + 1
            c -= s
    return float(best[capacity]), out


def _fullest(free: np.ndarray, gap: int) -> dict[int, int]:
    """Free lengths, any number of each, with the largest sum that fits the gap: few and long ones where that is easy,
    else by the dynamic program over reachable sums, kept as the bits of one number."""
    if gap <= 0:
        return {}
    if free[gap]:
        return {gap: 1}
    have = np.flatnonzero(free[: gap + 1])
    if not len(have):
        return {}
    pair = have[free[gap - have]]
    if len(pair):
        a = int(pair[-1])
        return {a: 2} if gap == 2 * a else {a: 1, gap - a: 1}
    reach, mask = 1, (1 << (gap + 1)) - 1
    for s in have[::-1].tolist():
        step = s
        while step <= gap:
            reach |= (reach << step) & mask
            step *= 2
        if reach >> gap & 1:
            break
    at, out = reach.bit_length() - 1, {}
    while at:
        s = next(s for s in have[::-1].tolist() if s <= at and reach >> (at - s) & 1)
        out[s] = out.get(s, 0) + 1
        at -= s
    return out


def _first_vertex(counts: dict[int, int], capacity: int) -> tuple[list[dict[int, int]], list[int], np.ndarray]:
    """Patterns priced at the area bound's duals, the length each covers last, and how often each is used."""
    left, free = np.zeros(capacity + 1), np.zeros(capacity + 1, bool)
    for s, n in counts.items():
        left[s], free[s] = n, True
    idle = free.copy()
    patterns, covers, x = [], [], []
    for big in sorted(counts, reverse=True):
        while free[big]:
            pattern = _fullest(free, capacity - big)
            pattern[big] = pattern.get(big, 0) + 1
            times, s = min((left[s] / k, s) for s, k in pattern.items())
            for t, k in pattern.items():
                left[t] -= k * times
                free[t] = left[t] > _EPS
            free[s] = idle[s] = False
            patterns.append(pattern)
            covers.append(s)
            x.append(times)
    for s in np.flatnonzero(idle).tolist():  # covered together with another length: a column of its own, unused
        patterns.append({s: capacity // s})
        covers.append(s)
        x.append(0.0)
    return patterns, covers, np.array(x)


@dataclass
class Program:
    """A solved linear program: patterns with their use, the objective and a lower bound of it."""

    patterns: list[tuple[dict[int, int], float]]
    objective: float
    bound: float
    priced: int


def solve_master(counts: dict[int, int], capacity: int) -> Program:
    """The linear program over all lengths, to within GAP of its lower bound."""
    area = sum(s * n for s, n in counts.items()) / capacity
    patterns, covers, x = _first_vertex(counts, capacity)
    priced, bound = len(patterns), area
    sizes = np.array(sorted(counts))
    row = {int(s): i for i, s in enumerate(sizes)}
    inverse = None
    while x.sum() > bound * (1 + GAP):
        if inverse is None:
            # Each pattern holds the length it covers and such as later patterns cover: triangular.
            matrix = np.zeros((len(sizes), len(sizes)))
            for j, pattern in enumerate(patterns):
                for s, k in pattern.items():
                    matrix[row[s], j] = k
            inverse = np.linalg.inv(matrix)
            basis = list(range(len(patterns)))
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), sizes, capacity)
        bound = max(bound, x.sum() / max(value, 1.0))  # Farley
        if value <= 1 + GAP:
            break
        column = np.zeros(len(sizes))
        for s, k in pattern.items():
            column[row[s]] = k
        direction = inverse @ column
        grows = direction > _EPS
        ratio = np.where(grows, np.maximum(x, 0) / np.where(grows, direction, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        patterns.append(pattern)
        basis[out] = len(patterns) - 1
        priced += 1
    used = range(len(x)) if inverse is None else basis
    return Program([(patterns[b], float(v)) for b, v in zip(used, x, strict=True) if v > _EPS], float(x.sum()), bound, priced)


def _complement(left: np.ndarray, gap: int) -> list[int] | None:
    """Up to three available lengths that fill the gap exactly, larger first."""
    if gap < len(left) and left[gap] > 0:
        return [gap]
    have = np.flatnonzero(left[: gap + 1])
    other = have[(gap - have >= have)][::-1]
    ok = (left[gap - other] > 0) & ((gap - other != other) | (left[other] > 1))
    if ok.any():
        b = int(other[ok][0])
        return [gap - b, b]
    for a in have[::-1].tolist():
        rest = gap - a
        if rest <= 0:
            continue
        other = have[(rest - have >= have) & (have > 0)][::-1]
        ok = left[rest - other] > (rest - other == a)
        ok &= left[other] > (other == a).astype(int) + (other == rest - other)
        if ok.any():
            b = int(other[ok][0])
            if rest - b:
                return [a, rest - b, b]
    return None


def _subset(left: np.ndarray, gap: int) -> list[int]:
    """Available lengths with the largest sum that fits the gap."""
    reach, steps, have = 1, [], []
    for s in np.flatnonzero(left[: gap + 1])[::-1].tolist():
        for _ in range(min(int(left[s]), gap // s)):
            steps.append(reach)
            have.append(s)
            reach |= (reach << s) & ((1 << (gap + 1)) - 1)
        if reach >> gap & 1:
            break
    at, out = reach.bit_length() - 1, []
    for s, before in zip(reversed(have), reversed(steps), strict=True):
        if not before >> at & 1:
            out.append(s)
            at -= s
    return out


def programmed(left: np.ndarray, capacity: int) -> tuple[list[tuple[list[tuple[int, int]], int]], list[Program]]:
    """Rounded patterns of the linear programs, taken off ``left`` (pieces of each length), and the programs."""
    out: list[tuple[list[tuple[int, int]], int]] = []
    solved: list[Program] = []
    before = left.sum()
    while before:
        program = solve_master({s: int(left[s]) for s in np.flatnonzero(left).tolist()}, capacity)
        solved.append(program)
        whole = [(pattern, int(v + 1e-6), v - int(v + 1e-6)) for pattern, v in program.patterns]
        rounds = [(pattern, n) for pattern, n, _ in whole] + [(pattern, 1) for pattern, _, part in sorted(whole, key=lambda w: -w[2]) if part >= 0.5]
        for pattern, n in rounds:
            if (times := min(n, *(int(left[s]) // k for s, k in pattern.items()))) > 0:
                out.append((sorted(pattern.items(), reverse=True), times))
                for s, k in pattern.items():
                    left[s] -= k * times
        if 2 * left.sum() > before:
            break
        before = left.sum()
    return out, solved


def plan(counts: dict[int, int], capacity: int = LENGTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as [(length, copies)], largest first, and how many sequences take each. All pieces are used exactly."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] += n
    out, _ = programmed(left, capacity)
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        left[big] -= 1
        rest = _complement(left, capacity - big) if capacity > big else []
        if rest is None:
            rest = _subset(left, capacity - big)
        left[big] += 1
        pattern: dict[int, int] = {}
        for s in [big, *rest]:
            pattern[s] = pattern.get(s, 0) + 1
        times = min(int(left[s]) // k for s, k in pattern.items())
        out.append((sorted(pattern.items(), reverse=True), times))
        for s, k in pattern.items():
            left[s] -= k * times
    return out


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, copies, first sequence, offset): ranks low to high of a length go to one pattern."""
    out, used, first = [], {}, 0
    for pattern, times in patterns:
        at = 0
        for s, k in pattern:
            low = used.get(s, 0)
            used[s] = low + k * times
            out.append((s, low, used[s], k, first, at))
            at += s * k
        first += times
    return out


def pack(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``found``: at least rid, start, length, all of it read twice."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``length`` rows
    table_ = np.array(sorted(slots(plan(histogram, length))), np.int64).reshape(-1, 6)
    salts = max(SALTS, -(-sum(histogram.values()) // SALT_ROWS))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("rid", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("rid", "start")
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    ranked = ranked.drop("salt", "base")
    names = [c for c in ranked.columns if c != "rank"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("slots")
        size, low, _, copies, first, at = table_.T
        step = np.int64(1) << np.int64(48)
        bounds = size * step + low
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(bounds, n * step + rank, "right") - 1
            nth = rank - low[i]
            more = [pa.array(first[i] + nth // copies[i]), pa.array(at[i] + nth % copies[i] * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place in the sequences."""
    found = stored(pieces(docs, path or tokenizer_path(), length, end_id, text, doc), "pieces")
    return pack(found, length).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
