"""Exact search for the greatest inner products, by KD-trees.

Vectors are dealt by hash to groups of bounded size. A task makes the trees of its group once, SHARD vectors each: split at
the median of the widest dimension, with the tight box of every node. All queries come to each group, in blocks of
QUERIES, and go through its trees best first: the tree, and in it the node, whose box allows the greatest product comes
next, and the search ends where no box reaches the k-th product found so far, which is carried from tree to tree.
What groups find is cut to k for each query. Queries are rows like the vectors: none is collected or broadcast, and
the count of jobs doesn't depend on them. Shuffled are the vectors once, and the queries once for each group.

Components become floor(1024 x), as integers; products of integers are exact (in doubles while they are below
2 ** 53, else in Python's integers, and cut to the range of a long).

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without id;
vectors of different lengths have no product; a row is never its own result, nor are others of its id; an id that is
repeated is one query (of its least vector) and one result (of its greatest product).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm._shared import map_batches, partitions, table

SHARD, LEAF, QUERIES = 16384, 256, 1024
#: Components of a group's vectors; in the task that searches it they take eight bytes each, twice while a tree is made.
GROUP_VALUES = 1 << 22
_EXACT = 2.0**53


class Tree:
    """Nodes in one array each: box, children, and for leaves the rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.low, self.high, self.children, self.leaf = [], [], [], []
        self._add(vectors, ids, k)
        self.lows, self.highs = np.array(self.low), np.array(self.high)
        self.reach, self.width = float(np.abs(vectors).max(initial=0)), vectors.shape[1]

    def _add(self, v: np.ndarray, ids: np.ndarray, k: int) -> int:
        me = len(self.low)
        low, high = v.min(0), v.max(0)
        self.low.append(low)
        self.high.append(high)
        self.children.append(None)
        self.leaf.append(None)
        wide = int(np.argmax(high - low))
        if high[wide] == low[wide]:
            # All equal: of their products only the least ids can be wanted, one of them the query's own.
            first = np.unique(ids)[: k + 1]
            self.leaf[me] = (v[: len(first)], first)
        elif len(v) <= LEAF:
            self.leaf[me] = (v, ids)
        else:
            half = len(v) // 2
            order = np.argpartition(v[:, wide], half)
            left = self._add(v[order[:half]], ids[order[:half]], k)
            self.children[me] = (left, self._add(v[order[half:]], ids[order[half:]], k))
        return me

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The greatest product that each node's box allows, for each query."""
        return np.maximum(q, 0) @ self.highs.T + np.minimum(q, 0) @ self.lows.T


def _products(v: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (v @ q).astype(np.int64)
    whole = v.astype(object) if v.dtype == object else np.vectorize(int, otypes=[object])(v)
    other = np.vectorize(int, otypes=[object])(q)
    found = [max(-(1 << 63), min((1 << 63) - 1, int(sum(a * b for a, b in zip(row, other, strict=True))))) for row in whole]
    return np.array(found, np.int64)


class Best:
    """The k best of each query so far: greater products first, then smaller ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.own, self.q, self.k = query_ids, queries, k
        self.score = [np.zeros(0, np.int64) for _ in query_ids]
        self.ids = [np.zeros(0, np.int64) for _ in query_ids]
        self.reach = float(np.abs(queries).max(initial=0))

    def kth(self, i: int) -> float:
        return float(self.score[i][-1]) if len(self.score[i]) == self.k else -np.inf

    def take(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score >= self.kth(i)) & (ids != self.own[i]) if len(self.score[i]) == self.k else ids != self.own[i]
        score, ids = np.concatenate([self.score[i], score[keep]]), np.concatenate([self.ids[i], ids[keep]])
        order = np.lexsort((ids, -score)) if len(score) and score.min() > -(1 << 63) else np.array(sorted(range(len(score)), key=lambda x: (-int(score[x]), int(ids[x]))), np.int64)
        ids, score = ids[order], score[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: self.k]
        self.score[i], self.ids[i] = score[first], ids[first]

    def search(self, trees: list[Tree]) -> None:
        allowed = [t.bounds(self.q) for t in trees]
        exact = [t.reach * self.reach * t.width < _EXACT for t in trees]
        for i in range(len(self.own)):
            # In doubles bounds may be rounded, where products are too large to be exact.
            slack = 0.0 if all(exact) else 1e-9
            heap = [(-allowed[t][i, 0], t, 0) for t in range(len(trees))]
            heapq.heapify(heap)
            while heap:
                most, t, node = heapq.heappop(heap)
                if -most + abs(most) * slack < self.kth(i):
                    break
                tree = trees[t]
                if tree.leaf[node] is not None:
                    rows, own = tree.leaf[node]
                    self.take(i, _products(rows, self.q[i], exact[t]), own)
                else:
                    for child in tree.children[node]:
                        heapq.heappush(heap, (-allowed[t][i, child], t, child))


def scaled(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors of floor(1024 x)) of the rows that take part, for each length of vectors."""
    out: dict[int, tuple[list, list]] = {}
    lists = batch.column("embedding")
    length = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)
    end = np.cumsum(length)
    ids = batch.column("vec_id").to_pylist()
    wrong = np.concatenate([[0], np.cumsum(bad)])
    for i, n, e in zip(ids, length.tolist(), end.tolist(), strict=True):
        if i is not None and n and wrong[e] == wrong[e - n]:
            a, b = out.setdefault(n, ([], []))
            a.append(i)
            b.append(values[e - n : e])
    return [(np.array(a, np.int64), np.floor(1024 * np.array(b))) for a, b in out.values()]


def _searcher(k: int):
    """Rows sorted by (group, asked): a group's vectors, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trees, rows, asked = None, {}, {}, {}

        def plant(n: int) -> None:
            parts = rows.pop(n)
            trees.setdefault(n, []).append(Tree(np.concatenate([v for _, v in parts]), np.concatenate([i for i, _ in parts]), k))

        def answer(n: int) -> Iterator[pa.RecordBatch]:
            parts = asked.pop(n)
            best = Best(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), k)
            best.search(trees.get(n, []))
            size = [len(s) for s in best.score]
            if sum(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.own, size)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score))], names=["query_id", "vec_id", "score"])

        def add(to: dict[int, list], ids: np.ndarray, v: np.ndarray) -> int:
            """How many are held now."""
            to.setdefault(v.shape[1], []).append((ids, v))
            return sum(len(i) for i, _ in to[v.shape[1]])

        for batch in batches:
            keys = list(zip(batch.column("group").to_pylist(), batch.column("asked").to_pylist(), strict=True))
            lo = 0
            for hi in range(1, len(keys) + 1):
                if hi < len(keys) and keys[hi] == keys[lo]:
                    continue
                if keys[lo][0] != group:
                    for n in list(asked):
                        yield from answer(n)
                    group, trees, rows = keys[lo][0], {}, {}
                for ids, v in scaled(batch.slice(lo, hi - lo)):
                    n = v.shape[1]
                    if not keys[lo][1]:
                        if add(rows, ids, v) >= SHARD:
                            plant(n)
                        continue
                    for m in list(rows):
                        plant(m)
                    if add(asked, ids, v) >= QUERIES:
                        yield from answer(n)
                lo = hi
        for m in list(rows):
            plant(m)
        for n in list(asked):
            yield from answer(n)

    return run


def valid(df: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query its k greatest products among the vectors. Both have vec_id and embedding."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    # Rows that are invalid are out before one of several with an id is chosen.
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    values = rows.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    # Small inputs are dealt to all tasks too, as long as a group has some leaves' worth of vectors.
    groups = max(1, -(-values // GROUP_VALUES), min(partitions(spark), values // (1 << 18)))
    # The number of the input's partition, too: an id that many rows have isn't all in one group.
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "embedding", F.spark_partition_id()), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("asked"), "vec_id", "embedding")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asked"), "vec_id", "embedding")
    met = dealt.unionByName(every).repartitionById(groups, F.col("group")).sortWithinPartitions("asked")
    found = met.transform(map_batches, _searcher(k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
