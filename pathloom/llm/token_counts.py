"""Token counts of the parts of a text, from one encoding of the whole.

Tokens have byte offsets in the whole text. They are joined to the parts' intervals by binary search; a token
that lies in more than one part is allocated by a rule: to the part of its first byte (`first`), of its last
(`last`), or to the part that holds most of its bytes, the earlier of equals (`most`). Counts of parts add up to
that of the whole.

Defined results: a null text has no parts; an empty one has one part of no tokens; a line's break belongs to the
line that it ends; a null field is a part of no tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm import _words as W
from pathloom.llm._shared import free_name, map_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary's texts are cut before merging (fixed by the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")


@cache
def encoder(vocabulary: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding, and the bytes that each token has. The file is on every machine, at the same path."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        length[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def allocate(length: np.ndarray, starts: np.ndarray, total: int, rule: str = "first") -> np.ndarray:
    """Tokens of each part; length: bytes of each token, in order; starts: of the parts, ascending from 0; total: bytes of the whole."""
    end = np.cumsum(length)
    begin = end - length
    part = np.searchsorted(starts, begin, "right") - 1
    if rule != "first":
        last = np.searchsorted(starts, end - 1, "right") - 1
        if rule == "last":
            part = last
        else:
            bounds = np.append(starts, total)
            for t in np.flatnonzero(last > part):
                held = range(part[t], last[t] + 1)
                part[t] = max(held, key=lambda p: (min(end[t], bounds[p + 1]) - max(begin[t], bounds[p]), -p))
    return np.bincount(part, minlength=len(starts))


def line_starts(data: bytes) -> np.ndarray:
    """Where lines begin; a break at the very end begins none."""
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A) + 1
    return np.concatenate([[0], breaks[breaks < len(data)]])


def _counted(rows: Iterator[tuple[object, str, np.ndarray, bytes]], vocabulary: str, rule: str, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoding, length = encoder(vocabulary)
    ids, part, chars, tokens = [], [], [], []
    for key_value, text, starts, data in rows:
        n = allocate(length[np.array(encoding.encode_ordinary(text), np.int64)], starts, len(data), rule)
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        ids.extend([key_value] * len(starts))
        part.append(np.arange(len(starts), dtype=np.int32))
        chars.append(np.diff(heads[np.append(starts, len(data))]))
        tokens.append(n)
    if ids:
        whole = [np.concatenate(x) for x in (part, chars.copy(), tokens)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, key), pa.array(whole[0]), pa.array(whole[1].astype(np.int64)), pa.array(whole[2].astype(np.int64))], names=["doc_id", "section", "n_chars", "n_tokens"])


def _lines(vocabulary: str, rule: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = ((i, t) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if t is not None)
                yield from _counted(((i, t, line_starts(data := t.encode()), data) for i, t in texts), vocabulary, rule, pa.int64())

    return run


def section_tokens(documents: DataFrame, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section (line of the text, from 0), n_chars and n_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    return documents.select("doc_id", "text").transform(map_batches, _lines(vocabulary, rule), "doc_id long, section int, n_chars long, n_tokens long")


def field_tokens(df: DataFrame, key: str, fields: Sequence[str], between: str = "\n", rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, field and n_tokens (_field or _n_tokens if the key is named so): fields are joined by `between`, which belongs to the field before it, and encoded as one."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    parts = F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, values in zip(batch.column("key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                pieces = [v + (between if k < len(values) - 1 else "") for k, v in enumerate(values)]
                sizes = [len(p.encode()) for p in pieces]
                text = "".join(pieces)
                rows.append((i, text, np.cumsum([0, *sizes[:-1]]), text.encode()))
            yield from _counted(iter(rows), vocabulary, rule, batch.column("key").type)

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("section", T.IntegerType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType())])
    found = df.select(F.col(f"`{key}`").alias("key"), parts.alias("parts")).transform(map_batches, run, schema)
    return found.select(F.col("doc_id").alias(key), F.get(F.array(*map(F.lit, fields)), F.col("section")).alias(free_name([key], "field")), F.col("n_tokens").alias(free_name([key], "n_tokens")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
