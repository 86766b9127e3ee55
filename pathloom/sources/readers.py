"""Documents from files: one row each, with the JSON text, the VARIANT and the file it is from.

Compressed files are read by their extension (one task a file, as gzip can't be split).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans.jsontext import documents as split_documents
from pathloom.plans.jsontext import fault
from pathloom.sources.arrays import END, elements

FORMATS = ("lines", "whole", "concatenated", "array")


def prepare(spark: SparkSession) -> SparkSession:
    """Of a key that an object repeats, the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def plain_quotes(text: Column | str) -> Column:
    """Strings in triple quotes, in which everything stands for itself, as ordinary JSON strings."""
    parts = F.split(F.col(text) if isinstance(text, str) else text, '"""', -1)
    quoted = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")).otherwise(x))
    return F.array_join(quoted, "")


#: Characters of documents that a task holds at once, besides its file.
SPLIT_CHARS, SPLIT_ROWS = 1 << 20, 10_000


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, text in zip(batch["file"], batch["text"], strict=True):
            found, held = [], 0
            for document in split_documents(text):
                found.append(document)
                held += len(document)
                if held >= SPLIT_CHARS or len(found) >= SPLIT_ROWS:
                    yield pd.DataFrame({"file": file, "text": found})
                    found, held = [], 0
            if found:
                yield pd.DataFrame({"file": file, "text": found})


@F.pandas_udf(T.StringType())
def _fault(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fault(t) or "nested deeper than a VARIANT can be, or too large for one")


def fault_of(text: Column) -> Column:
    """Why a text is no JSON, with the position; Python, for the few that are none. NULL for NULL."""
    return _fault(text)


def _texts(reader, paths: str | list[str], form: str) -> DataFrame:
    texts = reader.text(paths, wholetext=form != "lines")
    return texts.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def _with_values(texts: DataFrame, form: str, triple_quotes: bool) -> DataFrame:
    if triple_quotes:
        texts = texts.withColumn("text", plain_quotes("text"))
    if form == "concatenated":
        texts = texts.select("file", "text").mapInPandas(_split, "file string, text string")
    if form == "lines":
        texts = texts.where(F.trim(F.col("text"), F.lit(" \t\r\n")) != "")
    return texts.withColumn("document", F.try_parse_json("text"))


def read_documents(spark: SparkSession, paths: str | list[str], form: str = "lines", triple_quotes: bool = False) -> DataFrame:
    """file, text and document of each document; document is NULL where the text is no JSON.

    form: lines (a document a line; blank lines are none), whole (a document, or an array of documents, a file), array
    (as whole, for arrays of any size: each element is a document, and many tasks read one file)
    or concatenated (documents one after the other, over lines or within one; what is between them and is neither white
    space, comma nor a scalar is a document that is no JSON).
    Root arrays are opened by the selection.
    """
    if form not in FORMATS:
        raise ValueError(f"form is one of {', '.join(FORMATS)}")
    if form == "array":
        if triple_quotes:
            raise ValueError("arrays that are read by element have no triple quotes")
        chunks = prepare(spark).read.option("lineSep", END).text(paths)
        chunks = chunks.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
        return elements(chunks).withColumn("document", F.try_parse_json("text"))
    return _with_values(_texts(prepare(spark).read, paths, form), form, triple_quotes)


def stream_documents(spark: SparkSession, path: str, form: str = "lines", triple_quotes: bool = False, **options: str) -> DataFrame:
    """As read_documents(), for files that arrive in a folder."""
    if form not in FORMATS or form == "array":
        raise ValueError(f"form is one of {', '.join(f for f in FORMATS if f != 'array')}")
    reader = prepare(spark).readStream.options(**options).option("wholetext", str(form != "lines").lower())
    texts = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return _with_values(texts, form, triple_quotes)


def from_texts(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    """As read_documents(), of texts at hand; file is NULL."""
    rows = [(None, t) for t in texts]
    df = prepare(spark).createDataFrame(rows, T.StructType([T.StructField("file", T.StringType()), T.StructField("text", T.StringType())]))
    return df.withColumn("document", F.try_parse_json("text"))


def good_and_bad(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those that are JSON, and those that aren't, with `error`: what is wrong, and where."""
    bad = documents.where(F.col("document").isNull() & F.col("text").isNotNull()).drop("document")
    return documents.where(F.col("document").isNotNull()), bad.withColumn("error", fault_of(F.col("text")))


def strictly(documents: DataFrame) -> DataFrame:
    """documents, failing on the first that is no JSON."""
    bad = F.when(F.col("document").isNull(), F.col("text"))
    found = documents.withColumn("__loom_fault", fault_of(bad))
    shown = F.concat(F.lit("no JSON: "), "__loom_fault", F.lit(": "), F.substring("text", 1, 80))
    return found.where(F.when(F.col("__loom_fault").isNotNull(), F.raise_error(shown).cast("boolean")).otherwise(F.lit(True))).drop("__loom_fault")
