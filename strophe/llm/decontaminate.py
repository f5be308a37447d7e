"""Benchmark decontamination: a broadcast set of normalised test n-grams against every token window.

DataFrame functions only. A benchmark item of at least ``WIDTH`` words gives all its windows of ``WIDTH``
consecutive words; a shorter one gives itself as one window. The distinct windows are bounded by the size of the
benchmark, not of the corpus: up to ``MAX_BROADCAST`` of them travel with the plan as hash sets (one of word pairs
that begin a window, one of whole windows, so that nearly all positions cost one lookup and the rest are compared
word by word). A larger benchmark is joined by shuffle on the window's hash instead, with the same result: the hits are
verified word by word, and rows find them by a hash of their text.

Defined results: null, empty or wordless texts have no words, no hits and are never contaminated; null or wordless
items have no windows; repeated rows each get their own result; an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import ascii_lower, content_key, plan_row, table

WIDTH = 13
#: Distinct windows that may be carried as sets (about 100 bytes each).
MAX_BROADCAST = 100_000
#: Characters that separate words; words are the runs of all others.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; a null text has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """Distinct windows of a benchmark: ``grams`` (item_id, gram, width), and how many there are."""

    grams: DataFrame
    widths: dict[int, int]

    @property
    def size(self) -> int:
        return sum(self.widths.values())


def index(benchmark: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> Index:
    w = F.col("w")
    n = F.size(w)
    per_item = (
        benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("w"))
        .filter(n > 0)
        .select(
            "item_id",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))),
                    lambda i: F.array_join(F.slice(w, i, F.least(n, F.lit(width))), " "),
                )
            ).alias("gram"),
            F.least(n, F.lit(width)).alias("width"),
        )
        .distinct()
    )
    widths = {r["width"]: r["n"] for r in per_item.groupBy("width").agg(F.countDistinct("gram").alias("n")).collect()}
    return Index(per_item, widths)


def _sets(idx: Index) -> dict[int, tuple[list[str], list[str]]]:
    """For each width the windows and the word pairs they begin with: bounded by MAX_BROADCAST."""
    out: dict[int, tuple[set, set]] = {}
    for r in idx.grams.select("gram", "width").distinct().collect():
        grams, heads = out.setdefault(r["width"], (set(), set()))
        grams.add(r["gram"])
        heads.add(" ".join(r["gram"].split(" ")[:2]))
    return {k: (sorted(g), sorted(h)) for k, (g, h) in out.items()}


def _quoted(values: list[str]) -> str:
    return ",".join(f"'{v}'" for v in values)  # words hold no quotes and no backslashes


def _hits_expr(width: int, grams: list[str], heads: list[str]) -> str:
    head = "element_at(w, i)" if width == 1 else "concat(element_at(w, i), ' ', element_at(w, i + 1))"
    return (
        f"CASE WHEN size(w) >= {width} THEN transform(filter(sequence(1, size(w) - {width - 1}), i -> {head} IN ({_quoted(heads)})"
        f" AND array_join(slice(w, i, {width}), ' ') IN ({_quoted(grams)})), i -> named_struct('pos', i, 'width', {width}))"
        " ELSE array() END"
    )


def covered(hits: Column) -> Column:
    """Words inside at least one of the (pos, width) windows."""
    start = F.struct(F.lit(0).alias("n"), F.lit(1).alias("free"))
    return F.aggregate(
        F.array_sort(hits),
        start,
        lambda s, h: F.struct(
            (s["n"] + F.greatest(h["pos"] + h["width"] - F.greatest(h["pos"], s["free"]), F.lit(0))).alias("n"),
            F.greatest(s["free"], h["pos"] + h["width"]).alias("free"),
        ),
        lambda s: s["n"],
    )


_NO_HITS = "CAST(array() AS array<struct<pos:int,width:int>>)"


def scan(docs: DataFrame, idx: Index, text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with ``w`` (its words) and ``hits`` (the verified windows: 1-based word position and width)."""
    out = docs.withColumn("w", words(F.col(text)))
    if not idx.size:
        return out.withColumn("hits", F.expr(_NO_HITS))
    if idx.size <= max_broadcast:
        parts = [_hits_expr(width, *sets) for width, sets in sorted(_sets(idx).items())]
        return out.withColumn("hits", F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]))
    # The set has no proven bound: distinct texts' windows meet the items by a shuffle join on 128-bit hashes, and what
    # is met is compared word by word, as equal hashes may differ.
    grams = idx.grams.select("gram", "width").distinct().select("gram", "width", *_gram_hash(F.split("gram", " ")))
    out = out.withColumn(_KEY, content_key(F.col(text)))
    each = F.explode(F.array(*[F.lit(x) for x in sorted(idx.widths)]))
    at = (
        out.select(_KEY, "w").groupBy(_KEY).agg(F.first("w").alias("w"))
        .select(_KEY, "w", each.alias("width"))
        .filter(F.size("w") >= F.col("width"))
        .select(_KEY, "w", "width", F.explode(F.expr("sequence(1, size(w) - width + 1)")).alias("pos"))
        .select(_KEY, "width", "pos", *_gram_hash(F.expr("slice(w, pos, width)")))
    )
    met = at.join(grams, ["g1", "g2", "width"]).groupBy(_KEY).agg(F.collect_set(F.struct("pos", "width", "gram")).alias("met"))
    equal = F.expr("transform(filter(met, h -> array_join(slice(w, h.pos, h.width), ' ') = h.gram), h -> named_struct('pos', h.pos, 'width', h.width))")
    return out.join(met, _KEY, "left").withColumn("hits", F.coalesce(equal, F.expr(_NO_HITS))).drop(_KEY, "met")


_KEY = "_text_key"


def _gram_hash(words_: Column) -> list[Column]:
    return [F.xxhash64(words_).alias("g1"), F.xxhash64(F.lit(13), words_).alias("g2")]


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least one word in twenty lies in a benchmark window."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    found = scan(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_row", F.col(f"`{text}`").alias("_t")), index(benchmark), "_t")
    marked = found.select("_row", contaminated(covered(F.col("hits")), F.size("w")).alias("_bad"), plan_row().alias("_at"))
    # A filter on _bad alone would be pushed below the words and put their split inside the scan's lambdas, once for
    # each word of a text. The row number is not deterministic, so a filter that needs it stays above.
    return marked.filter(~F.col("_bad") & (F.col("_at") >= 0)).select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All documents; hit words are cut out of the text, with what separates them from the word before.

    Texts without hits stay as they are. In texts with hits that hold the control character U+0001, the words that stay
    are joined by one space.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = scan(docs.select(row, F.col(f"`{text}`").alias("_t")), index(benchmark), "_t", max_broadcast)
    # The text as separator, word, separator, word, ..., tail: the k-th word keeps the separator before it.
    pieces = F.split(F.regexp_replace(F.col("_t"), "([0-9A-Za-z\\x{80}-\\x{10FFFF}]+)", "\u0001$1\u0001"), "\u0001")
    hit = F.expr("flatten(transform(hits, h -> sequence(h.pos, h.pos + h.width - 1)))")
    cut = F.expr("concat_ws('', transform(_p, (p, k) -> CASE WHEN k < size(_p) - 1 AND array_contains(_h, (k DIV 2) + 1) THEN '' ELSE p END))")
    plain = F.expr("array_join(filter(w, (x, k) -> NOT array_contains(_h, k + 1)), ' ')")
    out = found.withColumn("_h", F.array_distinct(hit)).withColumn("_p", pieces)
    new = F.when(F.size("hits") == 0, F.col("_t")).when(F.instr(F.col("_t"), "\u0001") > 0, plain).otherwise(cut).alias(text)
    return out.select(*[new if c == text else F.col(f"_row.`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: words, hit words, items with a window in it, and the contamination flag."""
    idx = index(benchmark)
    found = scan(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), idx, "text", max_broadcast)
    rows = found.select(
        plan_row().alias("rid"),
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        covered(F.col("hits")).cast("long").alias("n_hit"),
        F.expr("array_distinct(transform(hits, h -> array_join(slice(w, h.pos, h.width), ' ')))").alias("grams"),
    )
    each = rows.select("rid", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram"))
    items = idx.grams.select("gram", "item_id")
    if idx.size <= max_broadcast:
        items = F.broadcast(items)
    per_doc = (
        each.join(items, "gram", "left")
        .groupBy("rid", "doc_id", "n_words", "n_hit")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )
    return per_doc.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS width, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT rid, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i
  FROM d, (SELECT DISTINCT width FROM g) WHERE len(w) >= width),
h AS (
  SELECT rid, i, p.width, item_id FROM (SELECT rid, width, i, array_to_string(w[i : i + width - 1], ' ') AS gram FROM p) p
  JOIN g ON g.gram = p.gram AND g.width = p.width),
c AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + width - 1)) AS k FROM h) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
