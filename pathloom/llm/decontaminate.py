"""Benchmark decontamination, in DataFrame functions only.

The n-grams of the benchmark, normalised, are a broadcast hash set. Every window of every document is
hashed and looked up where it is made, so windows are never shuffled; a hit is verified word by word
against the benchmark's own n-gram. Words hit are merged to spans; spans or whole documents go.

Defined results: null or empty texts have no words and no hits; an item of fewer than n words (but some)
is one window of its length; an item without id marks words but is not counted; repeated rows each get
the same result; columns other than the id and the text pass through untouched, whatever their names (those that begin with
__loom_ are taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm._shared import free_name, table

#: What is between words: every ASCII byte but 0-9 and a-z, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark windows (of one item each) that are broadcast at a time; more are dealt with in blocks of about this many.
BLOCK_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased words; null and empty texts give an empty array.

    lower() is the fast way to lower A-Z, but right only for ASCII texts.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def _gram_hash(ws: Column, at: Column, n: int) -> Column:
    """Hash of the n words from 0-based place `at` on, and of n itself."""
    return F.xxhash64(F.lit(n), *(F.get(ws, at + k) for k in range(n)))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: size, gram (their words), key (hash) and items (ids as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
    items = items.where(F.size("ws") > 0).withColumn("size", F.least(F.size("ws"), F.lit(n)))
    each = items.select("item", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1), lambda i: F.slice("ws", i, F.col("size")))).alias("gram"))
    each = each.groupBy("size", "gram").agg(F.collect_set("item").alias("items"))
    key = F.lit(None).cast("long")
    for k in range(1, n + 1):
        key = F.when(F.col("size") == k, _gram_hash(F.col("gram"), F.lit(0), k)).otherwise(key)
    return each.withColumn("key", key)


def hits(documents: DataFrame, benchmark: DataFrame, n: int = 10, block: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document with a hit, known by its id and its text's hash.

    Columns: doc_id, text_hash, spans (merged, of words from start up to end), n_hit and items (sorted).
    """
    windows = benchmark_windows(benchmark, n)
    sizes = {r["size"]: (r["windows"], r["held"]) for r in windows.groupBy("size").agg(F.count("*").alias("windows"), F.sum(F.size("items")).alias("held")).collect()}
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    # The outer form: else a filter that splits every text again is put below the generator.
    at = docs.select("doc_id", "text_hash", "ws", F.posexplode_outer("ws").alias("at", "word"))
    if len(sizes) == 1:
        (size,) = sizes
        at = at.withColumn("size", F.lit(size)).where(F.col("at") <= F.size("ws") - size).withColumn("doc_key", _gram_hash(F.col("ws"), F.col("at"), size))
    else:
        # Windows of all sizes from one pass over the words. explode() and array() stay in the generated code, where the words aren't copied for each window.
        each = [F.struct(F.lit(k).alias("size"), F.when(F.col("at") <= F.size("ws") - k, _gram_hash(F.col("ws"), F.col("at"), k)).alias("doc_key")) for k in sorted(sizes)]
        at = at.select("doc_id", "text_hash", "ws", "at", F.explode(F.array(*each) if each else F.array().cast("array<struct<size:int,doc_key:long>>")).alias("w"))
        at = at.select("doc_id", "text_hash", "ws", "at", "w.size", "w.doc_key").where("doc_key IS NOT NULL")
    # A window fills about as much as its items' ids do; both are in the bound.
    blocks = max(1, -(-sum(count + held for count, held in sizes.values()) // block))
    found = None
    for b in range(blocks):
        part = windows.where(F.pmod(F.col("key"), F.lit(blocks)) == b) if blocks > 1 else windows
        # Two comparisons, as an equality would become a join key and cut a slice for every window, not for those found only.
        window = F.slice("ws", F.col("at") + 1, at["size"])
        same = (F.col("doc_key") == F.col("key")) & (window <= F.col("gram")) & (window >= F.col("gram"))
        hit = at.join(F.broadcast(part.select("key", "gram", "items")), same).select("doc_id", "text_hash", F.col("at").alias("start"), (F.col("at") + at["size"]).alias("end"), "items")
        found = hit if found is None else found.unionByName(hit)
    # Hits in order: one opens a span where it starts beyond the ends of all before it. A document's hits pass a window
    # that keeps one running maximum, so a long text with many hits costs no more than its hits.
    document = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("before", F.max("end").over(document))
    fresh = F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0)))
    opens = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), F.struct("start", "before"))
    grouped = placed.groupBy("doc_id", "text_hash").agg(
        F.sum(F.greatest(fresh, F.lit(0))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(opens)).alias("opens"),
        F.max("end").alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    ends = F.concat(F.slice("opens.before", F.lit(2), F.size("opens")), F.array("last"))
    spans = F.zip_with("opens.start", ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return grouped.select("doc_id", "text_hash", spans.alias("spans"), "n_hit", "items")


def _beside_hits(documents: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """documents with one struct column more, null where there is no hit, and that column."""
    key, text, hit = (free_name(documents.columns, x) for x in ("_id", "_hash", "_hit"))
    found = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text), F.struct("spans", "n_hit", "items").alias(hit))
    both = documents.join(found, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left")
    return both.drop(key, text), F.col(hit)


def report(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted), contaminated."""
    found = hits(documents, benchmark, n)
    counted = documents.select("doc_id", "text", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    # Only the id, the hash and the count of words are shuffled.
    counted = counted.select("doc_id", F.xxhash64("text").alias("_h"), "n_words")
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_hit", "items")
    both = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none)
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def remove_documents(documents: DataFrame, benchmark: DataFrame, n: int = 10, share: float = 0.0) -> DataFrame:
    """The documents of which at most `share` of the words is hit, with their own columns."""
    both, hit = _beside_hits(documents, hits(documents, benchmark, n))
    bad = hit["n_hit"] > (share * F.size(words(F.col("text"))) if share else F.lit(0))
    return both.where(~F.coalesce(bad, F.lit(False))).select(*(documents[f"`{c}`"] for c in documents.columns))


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Documents without the words hit; a text that is cut is its other words, normalised and joined by spaces."""
    both, hit = _beside_hits(documents, hits(documents, benchmark, n))
    ws, spans = words(F.col("text")), hit["spans"]
    # A flag for each word, by runs: each array is gone through once.
    runs = F.zip_with(F.concat(F.array(F.lit(0)), spans["end"]), spans, lambda e, s: F.when(s.isNotNull(), F.concat(F.array_repeat(F.lit(True), s["start"] - e), F.array_repeat(F.lit(False), s["end"] - s["start"]))))
    kept = F.array_compact(F.zip_with(ws, F.flatten(F.array_compact(runs)), lambda w, f: F.when(F.coalesce(f, F.lit(True)), w)))
    text = F.when(hit.isNull(), F.col("text")).otherwise(F.array_join(kept, " "))
    return both.select(*(text.alias("text") if c == "text" else documents[f"`{c}`"] for c in documents.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)
), w AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(ws) >= n)
), h AS (
  SELECT r, i, w.n, item_id FROM w JOIN g ON w.gram = g.gram AND w.n = g.n
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
