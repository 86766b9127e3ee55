"""Substring dedup by level-wise doubling.

Windows of half the length are taken first. Of the half windows inside each full window only the one with
the least hash is kept (equal full windows choose the same one), so about a fifth of the places is shuffled.
Full windows that chose the same place are a run. Runs equal as a whole are resolved at once: all but the
first go. Of the rest only those whose half window is repeated between different runs survive, and these are
extended to twice the length; their full windows are compared with 128 bits of hash. No candidate survives
that level, as the wanted length is reached.

Groups are reduced where they arise, before the shuffle: in a slice of input one place of each run is left, and a task
remembers runs that it met more than once, so a hot passage has about one entry for each task. Hashes are dealt to
buckets, more of them for more text, so neither a hot passage nor a hot source gathers in one task.

Defined results: null and empty texts have no words; null ids come before all others; rows that share an id
are taken as one document (equal windows at equal places do not remove each other, and a text repeated under
an id is kept or cut alike); texts of fewer words than the window are kept. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import _words as W
from pathloom.llm._shared import map_batches, materialize, partitions, table

#: A null doc_id in order and as key.
NULL_ID = -(1 << 63)

_BLOBS = "kind int, bucket int, h binary, c binary, docs binary, ref binary, a binary, n binary"
_RUNS = "kind int, did long, tag int, a int, n int"
GONE, ASK, OPEN = 0, 1, 2
#: Bytes of text for a bucket of hashes; the hashes take about as much as the texts.
BUCKET_BYTES = 16 << 20


class _Places:
    """Places in documents, as arrays: two hashes, document id, tag of its text, first window and count of windows."""

    def __init__(self, h, c, did, tag, a, n):
        self.h, self.c, self.did, self.tag, self.a, self.n = h, c, did, tag, a, n

    def take(self, i) -> _Places:
        return _Places(*(x[i] for x in (self.h, self.c, self.did, self.tag, self.a, self.n)))

    def __len__(self) -> int:
        return len(self.h)

    def resolved(self) -> tuple[_Places, _Places, np.ndarray, np.ndarray]:
        """Those that repeat an earlier equal one; the firsts (with all ties); for each first, whether its h is in an unequal one, and whether it has an equal one."""
        p = self.take(np.lexsort((self.a, self.did, self.c, self.h)))
        if not len(p):
            return p, p, np.zeros(0, bool), np.zeros(0, bool)
        new_h = np.concatenate([[True], p.h[1:] != p.h[:-1]])
        new = new_h | np.concatenate([[True], p.c[1:] != p.c[:-1]])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)[group]
        gone = (p.did != p.did[head]) | (p.a != p.a[head])
        by_h = np.cumsum(new_h) - 1
        unequal = (np.bincount(by_h[new])[by_h] > 1)[~gone]
        equal = (np.bincount(group)[group] > 1)[~gone]
        return p.take(gone), p.take(~gone), unequal, equal


class _Met:
    """Places that a task has met and passed on, of hashes that it met more than once. A table of bounded size, in which later ones replace others."""

    SIZE = 1 << 16

    def __init__(self) -> None:
        self.used = np.zeros(self.SIZE, bool)
        self.at = _Places(*(np.zeros(self.SIZE, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int64, np.int64)))

    def repeats(self, p: _Places, equal: np.ndarray) -> np.ndarray:
        """Which of p repeat an earlier place that has been passed on; the others are passed on now. equal: those met more than once in p's slice."""
        i = (p.h & np.uint64(self.SIZE - 1)).astype(np.int64)
        known = self.used[i] & (self.at.h[i] == p.h) & (self.at.c[i] == p.c)
        late = known & ((p.did > self.at.did[i]) | (p.did == self.at.did[i]) & (p.a > self.at.a[i]))
        keep = np.flatnonzero((equal | known) & ~late)
        self.used[i[keep]] = True
        for mine, theirs in zip((self.at.h, self.at.c, self.at.did, self.at.a), (p.h, p.c, p.did, p.a), strict=True):
            mine[i[keep]] = theirs[keep]
        return late


def _pack(p: _Places, kind: int, bucket: np.ndarray, out: dict[str, list]) -> None:
    """Adds a row for each bucket; ids are written once for each row."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.diff(bucket[order])) + 1
    for i in np.split(order, bounds) if len(order) else []:
        q = p.take(i)
        docs, ref = np.unique(np.rec.fromarrays([q.did, q.tag], names="did,tag"), return_inverse=True)
        both = (docs["did"].astype("<i8").tobytes(), docs["tag"].astype("<i4").tobytes())
        hashes = (q.h.tobytes(), q.c.tobytes()) if kind == OPEN else (b"", b"")
        row = (kind, int(bucket[i[0]]), *hashes, b"".join(both), ref.astype("<u4" if len(docs) > 65535 else "<u2").tobytes(), q.a.astype("<i4").tobytes(), q.n.astype("<u2").tobytes())
        for name, x in zip(out, row, strict=True):
            out[name].append(x)


def _unpack(rows: list[dict]) -> _Places:
    cols: list[list] = [[] for _ in range(6)]
    for r in rows:
        k = len(r["docs"]) // 12
        ref = np.frombuffer(r["ref"], "<u4" if k > 65535 else "<u2")
        did, tag = np.frombuffer(r["docs"][: 8 * k], "<i8"), np.frombuffer(r["docs"][8 * k :], "<i4")
        each = (np.frombuffer(r["h"], "<u8"), np.frombuffer(r["c"], "<u8"), did[ref], tag[ref], np.frombuffer(r["a"], "<i4"), np.frombuffer(r["n"], "<u2"))
        for x, y in zip(cols, each, strict=True):
            x.append(y)
    return _Places(*(np.concatenate(x) for x in cols))


def _blob_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()], names=list(out))


def _run_batch(kind: int, p: _Places) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(p), kind, np.int32)), pa.array(p.did), pa.array(p.tag), pa.array(p.a.astype(np.int32)), pa.array(p.n.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "did", "tag", "a", "n"])


def _dealt(p: _Places, buckets: int, met: _Met) -> pa.RecordBatch:
    """Reduces a slice's places and packs what is left for the shuffle."""
    out: dict[str, list] = {k: [] for k in ("kind", "bucket", "h", "c", "docs", "ref", "a", "n")}
    gone, firsts, _, equal = p.resolved()
    late = met.repeats(firsts, equal)
    for part, kind in ((firsts.take(~late), OPEN), (gone, GONE), (firsts.take(late), GONE)):
        key = part.h if kind == OPEN else W.mix(part.did.astype(np.uint64) + part.tag.astype(np.uint64))
        _pack(part, kind, (key % np.uint64(buckets)).astype(np.int64), out)
    return _blob_batch(out)


def _runs_of(batch: pa.RecordBatch, window: int) -> _Places:
    """The runs of full windows that chose the same half window, for a slice of texts."""
    w = W.split(batch.column("text"))
    half = window // 2
    words = W.hashes(w)
    doc = w.owner()
    m = len(words) - window + 1
    if m <= 0:
        return _no_places()
    raw = W.grams(words, half)
    at_half = W.mix(raw.copy())
    full = W.mix(raw[: len(raw) - window + half] * np.uint64(pow(W._P, window - half, 1 << 64)) + W.grams(words, window - half)[half:]) if window > half else at_half
    inside = doc[:m] == doc[window - 1 :]
    least, chosen = at_half[:m].copy(), np.arange(m)
    for k in range(1, window - half + 1):
        less = at_half[k : k + m] < least
        np.copyto(least, at_half[k : k + m], where=less)
        chosen[less] = np.flatnonzero(less) + k
    begins = inside & np.concatenate([[True], (chosen[1:] != chosen[:-1]) | ~inside[:-1] | (doc[1:m] != doc[: m - 1])])
    first = np.flatnonzero(begins)
    if not len(first):
        return _no_places()
    own = np.flatnonzero(inside)
    run = np.cumsum(begins[own]) - 1
    n = np.bincount(run)
    step = (own - first[run]).astype(np.uint64)
    c = np.add.reduceat(W.mix(full[own] + step * np.uint64(0x9E3779B97F4A7C15)), np.flatnonzero(begins[own]))
    c = W.mix(c + n.astype(np.uint64))
    ids = batch.column("did").to_numpy(zero_copy_only=False)
    tags = batch.column("tag").to_numpy(zero_copy_only=False)
    d = doc[first]
    return _Places(least[first], c, ids[d], tags[d], (first - w.first[d]).astype(np.int32), n)


def _no_places() -> _Places:
    return _Places(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, n) of the list column `runs`."""
    runs = batch.column("runs")
    length = pa.compute.list_value_length(runs).fill_null(0).to_numpy(zero_copy_only=False)
    flat = runs.flatten()
    row = np.repeat(np.arange(len(length)), length)
    return row, flat.field("a").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)


def _windows_of(batch: pa.RecordBatch, window: int) -> _Places:
    """Every full window of the asked runs, with 128 bits of hash."""
    row, a, n = _spans(batch)
    w = W.split(batch.column("text"))
    place = np.repeat(w.first[row] + a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    two = [W.mix(W.grams(W.hashes(w, seed), window))[place] for seed in (3, 5)]
    row = np.repeat(row, n)
    ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tag"))
    return _Places(*two, ids[row], tags[row], (place - w.first[row]).astype(np.int32), np.ones(len(place), np.int64))


def _emit(places: Callable[[pa.RecordBatch, int], _Places], window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = _Met()
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield _dealt(places(part, window), buckets, met)

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted by bucket: all that share a hash are in one bucket."""
    held: list[dict] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            gone, firsts, unequal, _ = _unpack(held).resolved()
            held.clear()
            yield _run_batch(GONE, gone)
            yield _run_batch(ASK, firsts.take(unequal))

    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == GONE:
                yield _run_batch(GONE, _unpack([r | {"h": bytes(8 * (len(r["a"]) // 4)), "c": bytes(8 * (len(r["a"]) // 4))}]))
                continue
            if held and held[0]["bucket"] != r["bucket"]:
                yield from flush()
            held.append(r)
    yield from flush()


def _level(keyed: DataFrame, places: Callable, window: int, buckets: int) -> DataFrame:
    """A bucket is a partition: hashes fill them evenly."""
    blobs = keyed.transform(map_batches, _emit(places, window, buckets), _BLOBS)
    return blobs.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind").transform(map_batches, _resolve, _RUNS)


def _cut(window: int, text_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.split(part.column("text"))
                row, a, n = _spans(part)
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, w.first[row] + a, 1)
                np.add.at(change, w.first[row] + a + n - 1 + window, -1)
                kept = np.cumsum(change)[:-1] == 0
                gone = np.bincount(w.owner()[~kept], minlength=part.num_rows).astype(np.int64)
                text = W.join_kept(w, kept, part.num_rows)
                arrays = [part.column(i) for i, c in enumerate(part.schema.names) if c not in ("did", "tag", "runs", *(["text"] if text_only else []))]
                names = [c for c in part.schema.names if c not in ("did", "tag", "runs", *(["text"] if text_only else []))]
                yield pa.RecordBatch.from_arrays([*arrays, text, pa.array(w.counts.astype(np.int64)), pa.array(gone)], names=[*names, "kept", "n_words", "n_removed"])

    return run


def repeated_runs(keyed: DataFrame, window: int = 20) -> DataFrame:
    """Runs (did, tag, a, n): of document did, the n windows from word a on each repeat an earlier one.

    keyed has did, tag and text. The first level is written to the shared folder, as two readers follow.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    n_bytes = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(partitions(keyed.sparkSession), -(-n_bytes // BUCKET_BYTES))
    first = materialize(_level(keyed.select("did", "tag", "text"), _runs_of, window, buckets), "substring-runs")
    ask = first.where(F.col("kind") == ASK).groupBy("did", "tag").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    # All columns of keyed: the caller's own join then reuses this one's exchange of the texts.
    asked = keyed.join(ask, ["did", "tag"])
    second = _level(asked, _windows_of, window, buckets)
    return first.where(F.col("kind") == GONE).unionByName(second.where(F.col("kind") == GONE)).drop("kind")


def _tag():
    return F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int")


def keys(documents: DataFrame) -> DataFrame:
    """documents' id and text, with the key did (the id; null: least) and tag (of the text)."""
    return documents.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), _tag().alias("tag"), "text")


def dedup(documents: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, kept (the text left, its words joined by single spaces), n_words and n_removed of each document."""
    keyed = keys(documents)
    runs = repeated_runs(keyed, window).groupBy("did", "tag").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    both = keyed.join(runs, ["did", "tag"], "left")
    return both.select("tag", "text", "runs", F.nullif("did", F.lit(NULL_ID)).alias("doc_id")).transform(map_batches, _cut(window, True), "doc_id long, kept string, n_words long, n_removed long")


def remove_repeats(documents: DataFrame, window: int = 20) -> DataFrame:
    """documents with the repeated words cut; a text that repeats nothing stays as it is, one that is emptied goes.

    n_chars, if there is such a column, follows the text.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(documents.columns)}
    whole = documents.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), _tag().alias("tag"), "text", *(F.col(f"`{c}`").alias(i) for c, i in inner.items() if c != "text"))
    runs = repeated_runs(whole, window).groupBy("did", "tag").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    both = whole.join(runs, ["did", "tag"], "left").select(*whole.columns, "runs")
    added = [T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    cut = both.transform(map_batches, _cut(window, False), T.StructType([*both.drop("did", "tag", "runs").schema, *added]))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))

    def column(c: str):
        if c == "text":
            return text.alias("text")
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.char_length("kept").cast(documents.schema[c].dataType)).otherwise(F.col(inner[c])).alias(c)
        return F.col(inner[c]).alias(c)

    return cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(*map(column, documents.columns))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT r, coalesce(doc_id, -9223372036854775808) AS did, i, md5(array_to_string(ws[i:i + 19], ' ')) AS gram FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)
), f AS (
  SELECT gram, min({'d': did, 'i': i}) AS first FROM w GROUP BY gram
), x AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM w JOIN f USING (gram) WHERE first < {'d': did, 'i': i})
), k AS (
  SELECT r, p, word FROM (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN x USING (r, p)
), s AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""
