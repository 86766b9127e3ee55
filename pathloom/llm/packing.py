"""Best-fit packing under conflicts.

Pieces of documents (a text longer than a bin is cut in full bins and a rest) go into bins of a fixed capacity.
No bin holds two pieces of one source, nor two of one duplicate cluster: each bin carries a bitmap of either. Bins are
kept in the order of their residual; the search begins at the tightest that is large enough and goes on to its
successors until one is compatible; if none is, a bin opens. Pieces come longest first.

Pieces are dealt by hash to groups of about GROUP, each packed by itself: a task holds one group at a time, and
a hot source or cluster is spread over all groups like any other rows.

Duplicate clusters are the components of near copies in the registered query; pack() by itself takes exact copies for
them, or what it is given.

Defined results: a null or empty text is one piece of no words; a null source or cluster conflicts with nothing;
repeated rows are pieces of their own (and of one cluster); no rows, no bins. Nothing is dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import near
from pathloom.llm._shared import map_batches, materialize, partitions, table
from pathloom.llm.graph import components

CAPACITY = 2048
GROUP = 2048
#: Bins of a group are numbered below this.
_BINS = 1 << 20

SCHEMA = "doc_id long, piece int, n_words long, bin_id long, start long"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each piece (size, source, cluster), in their order."""
    pieces = list(pieces)
    members = Counter(c for _, _, c in pieces if c is not None)
    sources: dict = {}
    clusters: dict = {}
    bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    has: list[list[int]] = []  # of each bin: bitmap of sources, bitmap of clusters
    out = []
    for size, source, cluster in pieces:
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        # A cluster with one member here can't conflict, so it needs no bit.
        c = 1 << clusters.setdefault(cluster, len(clusters)) if cluster is not None and members[cluster] > 1 else 0
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (has[bins[at][1]][0] & s or has[bins[at][1]][1] & c):
            at += 1
        if at < len(bins):
            residual, number = bins.pop(at)
        else:
            residual, number = capacity, len(has)
            has.append([0, 0])
        out.append((number, capacity - residual))
        has[number][0] |= s
        has[number][1] |= c
        insort(bins, (residual - size, number))
    return out


def _pack_groups(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                placed = best_fit(((r["size"], r["source"], r["cluster"]) for r in held), capacity)
                columns = {"doc_id": pa.int64(), "piece": pa.int32(), "n_words": pa.int64(), "bin_id": pa.int64(), "start": pa.int64()}
                rows = [(r["doc_id"], r["piece"], r["size"], group * _BINS + b, s) for r, (b, s) in zip(held, placed, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))

        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != group:
                    yield from flush()
                    group, held = r["group"], []
                held.append(r)
        yield from flush()

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, group: int = GROUP, clusters: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, n_words, bin_id and start (in words) of each piece.

    cluster: what tells duplicate clusters, a long; else exact copies are one. clusters: node and component of the ids (see
    known_ids) whose cluster is not just their own.
    """
    cluster = F.xxhash64("text") if cluster is None else cluster
    cluster = F.when(F.col("text").isNotNull() & (F.col("text") != ""), cluster)
    whole = documents.select("doc_id", "source", cluster.alias("cluster"), F.xxhash64("text").alias("h"), n_words(F.col("text")).alias("n"))
    return _packed(whole, capacity, group, clusters)


def _packed(whole: DataFrame, capacity: int, group: int, clusters: DataFrame | None) -> DataFrame:
    """As pack(), of documents without their texts: doc_id, source, cluster (NULL for no text), h (the text's hash) and n (words)."""
    if capacity < 1:
        raise ValueError("a bin holds at least one word")
    spark = whole.sparkSession
    if clusters is not None:
        own = F.coalesce("doc_id", "h")
        whole = whole.join(clusters.select("node", "component"), own == F.col("node"), "left").withColumn("cluster", F.when(F.col("cluster").isNotNull(), F.coalesce("component", own))).drop("node", "component")
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0))
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = materialize(pieces.withColumn("size", F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("long")).drop("n"), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(groups)))
    dealt = dealt.repartition(partitions(spark), "group").sortWithinPartitions("group", F.desc("size"), "doc_id", "piece", "h", "source")
    return dealt.select("group", "doc_id", "piece", "source", "cluster", "size").transform(map_batches, _pack_groups(capacity), SCHEMA)


def known_ids(documents: DataFrame) -> DataFrame:
    """documents, with a hash of the text as the id of those without one."""
    return documents.withColumn("doc_id", F.coalesce("doc_id", F.xxhash64("text")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As pack() of the documents and their components. Words are counted where they are split for shingles, and texts read once for both."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    texts = known_ids(documents.withColumns({"own_id": F.col("doc_id"), "h": F.xxhash64("text"), "filled": F.coalesce(F.col("text") != "", F.lit(False))}))
    rows, links = near.near_links(texts, words=True, beside=["own_id", "source", "h", "filled"])
    whole = rows.select(F.col("own_id").alias("doc_id"), "source", F.when(F.col("filled"), F.col("h")).alias("cluster"), "h", F.col("n_words").alias("n"))
    return _packed(whole, CAPACITY, GROUP, components(links))
