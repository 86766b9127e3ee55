"""Selection from streams: stateless, so append mode and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pathloom.operators.select import select
from pathloom.plans.ast import PathExpr


def select_stream(df: DataFrame, column: str, path: str | PathExpr, *, strategy: str = "auto", **options) -> DataFrame:
    """select() on a stream. Documents of unknown depth: strategy 'udtf', or max_depth, beyond which the query fails."""
    if not df.isStreaming:
        raise ValueError("not a stream; take select()")
    if strategy == "recursive":
        raise ValueError("a stream can't be read recursively; take strategy 'unrolled' or 'udtf'")
    return select(df, column, path, strategy=strategy, **options)
