"""Files that are one large array each, read element by element by many tasks, in bounded memory.

Such a file has no lines to split it at, but Spark splits it all the same: it is read in chunks that end with a closing
brace, and what a split means depends only on whether it begins inside a string, and how deep. So there are two passes.
The first finds for each split, for either case, the change of depth and of being in a string; running sums over these few
rows, one for each split, tell where each split begins. The second cuts the splits at the commas between elements. What
straddles splits is put together from its fragments, of which each split has two at most.

An element has to fit in a task, not the file. A compressed file is one split, and streams through its task. Elements
that are no JSON, and anything around the arrays, become documents that won't parse; so do all parts of a file that isn't
an array. An array of which no element holds a closing brace is one chunk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

END = "}"
_ESCAPED = re.compile(rb"\\.", re.S)
_OPEN, _CLOSE = (np.isin(np.arange(256), [ord(c) for c in cs]).astype(np.int8) for cs in ("[{", "]}"))
_SIGN = np.isin(np.arange(256), [ord(c) for c in '"[]{},'])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, int]]:
    """(file and block, bytes, chunks) of consecutive rows of one block; the last chunk's brace is left out."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        lo = 0
        for hi in range(1, len(texts) + 1):
            if hi == len(texts) or (files[hi], blocks[hi]) != (files[lo], blocks[lo]):
                yield (files[lo], blocks[lo]), END.encode().join(texts[lo:hi]), hi - lo
                lo = hi


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, commas and brackets that aren't escaped, what is there, and the count of quotes up to each."""
    a = np.frombuffer(_ESCAPED.sub(b"  ", data) if b"\\" in data else data, np.uint8)
    at = np.flatnonzero(_SIGN[a])
    a = a[at]
    return at, a, np.cumsum(a == 0x22)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, quotes (whether an odd count), outside and inside: change of depth if the block begins out of or in a string."""
    key, held = None, [0, 0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("file", "block", "quotes", "outside", "inside"), (*key, *held), strict=True))], _EFFECTS)

    def add(data: bytes) -> None:
        _, a, quotes = _marks(data)
        change = _OPEN[a] - _CLOSE[a]
        odd = (quotes & 1).astype(bool)
        even, rest = int(change[~odd].sum()), int(change[odd].sum())
        if held[0]:
            even, rest = rest, even
        held[1] += even
        held[2] += rest
        held[0] ^= int(quotes[-1] & 1) if len(quotes) else 0

    for k, data, _ in _runs(batches):
        if k != key:
            if key:
                add(END.encode())
                yield row()
            key, held = k, [0, 0, 0]
        else:
            add(END.encode())
        add(data)
    if key:
        add(END.encode())
        yield row()


_EFFECTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64())])
#: Sides of a piece: what goes on from the block before, what begins in this block and goes on in the next, and what is whole.
_HEAD, _TAIL, _WHOLE = 0, 1, 2


def _cutter(starts: dict[tuple[str, int], tuple[int, int, bool]]):
    """file, block, side and text of the pieces; starts: of each block, whether it begins in a string, how deep, and whether it is its file's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, depth, cuts, held = None, 0, 0, 0, []

        def cut(data: bytes) -> list[tuple[int, bytes]]:
            nonlocal odd, depth, cuts, held
            places, a, quotes = _marks(data)
            if not len(a):
                held.append(data)
                return []
            out = ((quotes + odd) & 1 == 0) & (a != 0x22)
            change = np.where(out, _OPEN[a] - _CLOSE[a], 0)
            deep = depth + np.cumsum(change)
            # Commas between elements, and the brackets of the arrays themselves.
            at = places[out & ((a == 0x2C) & (deep == 1) | (a == 0x5B) & (deep == 1) | (a == 0x5D) & (deep == 0))]
            odd, depth = (odd + int(quotes[-1])) & 1, int(deep[-1])
            found, begin = [], 0
            for x in at.tolist():
                found.append((_WHOLE if cuts else _HEAD, b"".join([*held, data[begin:x]])))
                held, begin = [], x + 1
                cuts += 1
            held.append(data[begin:])
            return found

        def close() -> list[tuple[int, bytes]]:
            return [] if key is None else [*([] if starts[key][2] else cut(END.encode())), (_TAIL if cuts else _HEAD, b"".join(held))]

        def batch(pieces: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            pieces = [(s, t) for s, t in pieces if s != _WHOLE or t.strip(b" \t\r\n")]
            if pieces:
                side, text = zip(*pieces, strict=True)
                n = len(side)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array(side, pa.int32()), pa.array(text, pa.binary()).cast(pa.string(), safe=False)], names=["file", "block", "side", "text"])

        for k, data, _ in _runs(batches):
            if k != key:
                yield from batch(close())
                key, cuts, held = k, 0, []
                odd, depth, _ = starts[k]
            else:
                yield from batch(cut(END.encode()))
            yield from batch(cut(data))
        yield from batch(close())

    return run


def elements(chunks: DataFrame) -> DataFrame:
    """file and text of each element; chunks: file, block and text, as Spark's reader gives them split at END, unshuffled."""
    effects = chunks.mapInArrow(_effects, "file string, block long, quotes long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = effects.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    at = at.withColumn("own", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    at = at.withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
    at = at.withColumn("last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    # One row for each split of the input, of which the driver has a list anyway.
    starts = {(r["file"], r["block"]): (r["odd"], r["depth"], r["last"]) for r in at.select("file", "block", "odd", "depth", "last").collect()}
    pieces = chunks.mapInArrow(_cutter(starts), "file string, block long, side int, text string")
    # A fragment goes on until the next one that begins anew.
    order = Window.partitionBy("file").orderBy("block", "side")
    fragments = pieces.where(F.col("side") != _WHOLE).withColumn("element", F.sum(F.when(F.col("side") == _TAIL, 1).otherwise(0)).over(order))
    joined = fragments.groupBy("file", "element").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "side", "text"))), lambda x: x["text"]), "").alias("text"))
    return pieces.where(F.col("side") == _WHOLE).select("file", "text").unionByName(joined.where(F.trim("text", F.lit(" \t\r\n")) != "").select("file", "text"))
