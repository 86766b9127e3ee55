"""MinHash near-dedup: many universal hash minima, bands, verification, connected components.

A document is the set of its word shingles. Documents of equal sets are one class, of which the least id goes
on. Each set has MINIMA minima of multiply-shift hashes, in bands of ROWS; two sets of similarity 0.8 share no
band with a probability of 5e-6. The least id of a bucket is its centre, and all that share a bucket share its
centre; so the candidates are the members of a centre's group, and no list of pairs is made. Groups are cut in
blocks of BLOCK members and BLOCK_SHINGLES shingles. First each block meets the centre alone; members that are linked to it are
one with it already. What is left meets all blocks of the group, two blocks at a time; blocks of linked members never
meet each other, so a large group of copies costs no more than its texts. Where blocks meet the signatures are compared,
then the full sets. Of the links found in one place only a spanning forest leaves it: the components are the
same, and copies are never expanded into pairs.

Defined results: null and empty texts have an empty set and are linked with nothing, as are rows without id; a
text of fewer words than a shingle is one shingle; rows that share an id are one document (all of them stay or
go); equal sets are linked whatever their ids. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import _words as W
from pathloom.llm._shared import discard, free_name, map_batches, materialize, partitions, table
from pathloom.llm.graph import components

ROWS, BANDS = 6, 40
MINIMA = ROWS * BANDS
#: Minima that are compared before the full sets, and how far under the threshold an estimate may be (five standard deviations at 0.8).
CHECKED, SLACK = 64, 0.25
BLOCK, BLOCK_SHINGLES = 96, 1 << 21

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, MINIMA, dtype=np.uint64)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, and the bounds of each text's."""
    return shingles_of(W.split(texts, lower=True), k)


def shingles_of(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, doc, count = W.hashes(w), w.owner(), len(w.first) - 1
    g = W.mix(W.grams(words, k))
    own = doc[: len(g)] == doc[k - 1 :] if len(g) else np.zeros(0, bool)
    g, d = g[own], doc[: len(g)][own]
    n = w.counts
    short = (n > 0) & (n < k)
    size = np.where(short, 1, np.maximum(n - k + 1, 0))
    at = np.concatenate([[0], np.cumsum(size)])
    every = np.empty(at[-1], np.uint64)
    # Texts are in order; before a shingle are also those of short texts, of which each has one.
    every[np.arange(len(g)) + np.cumsum(short)[d]] = g
    for i in np.flatnonzero(short):
        # The whole of a short text: its words in order, and how many they are.
        every[at[i]] = W.mix(W.grams(words[w.first[i] : w.first[i + 1]], int(n[i])) + n[i].astype(np.uint64))[0]
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        every[lo:hi].sort()
    d = np.repeat(np.arange(count), size)
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (d[1:] != d[:-1])
    return every[new], np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=count))])


def minima(g: np.ndarray, bounds: np.ndarray, many: int) -> np.ndarray:
    """`many` minima for each non-empty set, in runs of sets that stay in the cache."""
    out = np.empty((many, len(bounds) - 1), np.uint64)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 32768, "right")) - 1)
        part, at = g[bounds[lo] : bounds[hi]], bounds[lo:hi] - bounds[lo]
        t = np.empty_like(part)
        for k in range(many):
            np.multiply(part, _A[k], out=t)
            t += _B[k]
            np.minimum.reduceat(t, at, out=out[k, lo:hi])
        lo = hi
    return out


def _features(k: int, words: bool, beside: list[str]):
    names = ["doc_id", "n_shingles", "s1", "s2", "bands", *["n_words"] * words, *beside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", W.SMALL_SLICE):
                w = W.split(part.column("text"), lower=True)
                g, bounds = shingles_of(w, k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, part.num_rows), np.uint64)
                bands = pa.array([None] * part.num_rows, pa.list_(pa.int64()))
                if len(full):
                    starts = bounds[:-1][full]
                    for s in (0, 1):
                        sums[s, full] = np.add.reduceat(W.mix(g ^ np.uint64(0x5851F42D4C957F2D * (s + 1) % (1 << 64))), starts)
                    m = minima(g, np.append(starts, len(g)), MINIMA).reshape(BANDS, ROWS, len(full))
                    keys = np.zeros((BANDS, len(full)), np.uint64)
                    for r in range(ROWS):
                        keys = W.mix(keys + m[:, r])
                    offsets = np.zeros(part.num_rows + 1, np.int32)
                    np.cumsum(BANDS * (n > 0), out=offsets[1:])
                    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.T.ravel().view(np.int64)))
                counted = [pa.array(w.counts.astype(np.int64))] if words else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums), bands, *counted, *(part.column(c) for c in beside)], names=names)

    return run


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence blocks of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    many = count[column] > 1
    owner, column = owner[many], number[column[many]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def linked(ids: list[int], side: list[int], sets: list[np.ndarray], cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between these sets; cross: only between sides."""
    forest, found = _Union(), []
    n = np.array([len(s) for s in sets])

    def test(i: int, j: int, both: int) -> None:
        if 100 * both >= percent * (n[i] + n[j] - both) and forest.join(ids[i], ids[j]):
            found.append((ids[i], ids[j]))

    if len(sets) == 2:
        if ids[0] != ids[1] and (not cross or side[0] != side[1]) and 100 * n.min() >= percent * n.max():
            test(0, 1, len(np.intersect1d(*sets, assume_unique=True)))
        return found
    sig = minima(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]), CHECKED)
    alike = np.zeros((len(sets), len(sets)), np.int32)
    for row in sig:
        alike += row[:, None] == row[None, :]
    may = (alike >= (percent / 100 - SLACK) * CHECKED) & (100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n))
    number, sides = np.array(ids), np.array(side)
    may &= number[:, None] != number
    if cross:
        may &= sides[:, None] != sides
    i, j = np.nonzero(np.triu(may, 1))
    if len(i) > 2 * len(sets):
        used = np.unique(np.concatenate([i, j]))
        both = np.zeros((len(sets), len(sets)))
        both[np.ix_(used, used)] = _shared_counts([sets[u] for u in used])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            test(a, b, int(both[a, b]))
    else:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(ids[a]) != forest.root(ids[b]):
                test(a, b, len(np.intersect1d(sets[a], sets[b], assume_unique=True)))
    return found


def _verify(k: int, percent: int):
    """Rows sorted by (centre, lo, hi): those that meet there, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, side, sets = zip(*held, strict=True)
                if found := linked(ids, side, sets, key[1] != key[2], percent):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            for part in W.slices(batch, "text", W.SMALL_SLICE):
                g, bounds = shingles(part.column("text"), k)
                rows = zip(*(part.column(c).to_pylist() for c in ("centre", "lo", "hi", "id", "side")), strict=True)
                for x, (centre, lo, hi, doc, side) in enumerate(rows):
                    if (centre, lo, hi) != key:
                        yield from flush()
                        key, held = (centre, lo, hi), []
                    held.append((doc, side, g[bounds[x] : bounds[x + 1]].copy()))
        yield from flush()

    return run


def near_links(documents: DataFrame, k: int = 5, percent: int = 80, words: bool = False, beside: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features of all rows (doc_id, n_shingles, s1, s2), and links (a, b) that connect what is alike.

    words: rows have n_words too. beside: columns of documents that rows keep; none has a name of theirs.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    schema = T.StructType.fromDDL("doc_id long, n_shingles long, s1 long, s2 long, bands array<long>" + ", n_words long" * words)
    schema = T.StructType([*schema.fields, *documents.select(*beside).schema.fields])
    rows = materialize(documents.select("doc_id", "text", *beside).transform(map_batches, _features(k, words, list(beside)), schema), "minhash")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # A table, so that the join below has an exchange on either side and a class of very many copies is split in it.
    classes = materialize(known.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    same = known.select("doc_id", "s1", "s2", "n_shingles").join(classes.where("copies > 1"), ["s1", "s2", "n_shingles"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    # The id is in the join's key too, so copies are dealt out evenly.
    firsts = known.join(classes.select("s1", "s2", "n_shingles", F.col("first").alias("doc_id")), ["s1", "s2", "n_shingles", "doc_id"]).select(F.col("doc_id").alias("id"), "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = firsts.groupBy("band", "key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialize(buckets, "buckets")
    members = firsts.join(buckets, ["band", "key"]).where("id <> centre").select("centre", "id", "n_shingles").distinct()
    members = materialize(members, "members")
    # Texts are shuffled once, and of these only those of members stay.
    wanted = members.select("id").unionByName(members.select(F.col("centre").alias("id"))).distinct()
    texts = materialize(texts.hint("merge").join(wanted, F.col("doc_id") == F.col("id")).select("id", "text"), "member-texts")
    own = materialize(members.groupBy("centre").agg(_blocks().alias("blocks")), "blocks")
    stars = _in_blocks(members.join(own, "centre")).withColumn("side", F.lit(0)).select("centre", F.col("block").alias("lo"), F.lit(CENTRE).alias("hi"), "id", "side")
    centres = stars.select("centre", "lo", "hi").distinct().withColumns({"id": F.col("centre"), "side": F.lit(1)})
    close = materialize(_meet(stars.unionByName(centres), texts, k, percent), "stars")
    # Who is left, and their groups with all members; the centre itself is in them as a linked one.
    told = members.join(close.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("centre"), F.lit(True).alias("linked")).distinct(), ["centre", "id"], "left")
    told = told.withColumn("rest", F.isnull("linked")).drop("linked")
    sizes = materialize(told.groupBy("centre").agg(_blocks(F.col("rest")).alias("n_rest"), _blocks(~F.col("rest")).alias("n_linked")).where("n_rest > 0"), "sizes")
    told = materialize(told.join(sizes, "centre"), "rest")
    rest = _in_blocks(told.where("rest").withColumnRenamed("n_rest", "blocks"))
    linked_ones = _in_blocks(told.where("NOT rest").withColumn("blocks", F.col("n_linked")))
    among = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    among = among.select("centre", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", F.col("block").alias("side"))
    to = rest.where("n_linked > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_linked") - 1)))
    to = to.select("centre", F.col("block").alias("lo"), (-2 - F.col("other")).alias("hi"), "id", F.lit(0).alias("side"))
    back = linked_ones.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)))
    back = back.select("centre", F.col("other").alias("lo"), (-2 - F.col("block")).alias("hi"), "id", F.lit(1).alias("side"))
    alike = _meet(among.unionByName(to).unionByName(back), texts, k, percent)
    links = materialize(alike.unionByName(close).unionByName(same), "links")
    discard(classes, buckets, members, texts, own, close, sizes, told)
    return rows, links


#: In place of a second block's number: the centre alone. Blocks of linked members are numbered -2, -3 and so on.
CENTRE = -1


def _blocks(of: Column | None = None) -> Column:
    """How many blocks the members take for which `of` holds."""
    many, size = (F.when(F.lit(True) if of is None else of, x) for x in (F.lit(1), F.col("n_shingles")))
    return F.greatest(F.ceil(F.count(many) / BLOCK), F.ceil(F.coalesce(F.sum(size), F.lit(0)) / BLOCK_SHINGLES)).cast("int")


def _in_blocks(members: DataFrame) -> DataFrame:
    return members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _meet(places: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among what meets in one place (centre, lo, hi); places has id and side too, and only sides that differ are compared if lo and hi do."""
    # A merge join at every size: how many places there are is unknown, and a plan that changes with it can't be judged by small runs.
    met = places.join(texts.hint("merge"), "id")
    met = met.repartition(partitions(places.sparkSession), "centre", "lo", "hi").sortWithinPartitions("centre", "lo", "hi")
    return met.transform(map_batches, _verify(k, percent), "a long, b long")


def near_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows, links = near_links(documents, k, percent)
    at = components(links)
    both = rows.select("doc_id", "n_shingles").join(at, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return both.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents without those whose component has a smaller id; rows without id stay."""
    _, links = near_links(documents, k, percent)
    name = free_name(documents.columns, "_dropped")
    dropped = components(links).select(F.col("node").alias(name))
    return documents.join(dropped, F.col("doc_id") == F.col(name), "left_anti")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=4)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT r, doc_id, count(g) AS n FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
), p AS (
  SELECT x.r AS a, y.r AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r
), e AS (
  SELECT DISTINCT na.doc_id AS a, nb.doc_id AS b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b
  WHERE 100 * m >= 80 * (na.n + nb.n - m) AND na.doc_id <> nb.doc_id
), f AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), t(x, y) AS (
  SELECT DISTINCT a, a FROM f UNION SELECT t.x, f.b FROM t JOIN f ON t.y = f.a
), c AS (
  SELECT x, min(y) AS component FROM t GROUP BY x
)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(component, doc_id) AS kept
FROM n LEFT JOIN c ON c.x = n.doc_id
"""
