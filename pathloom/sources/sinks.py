"""Where selected values go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def as_json_lines(selected: DataFrame) -> DataFrame:
    """One column `value`: each value as JSON on a line of its own."""
    return selected.select(F.to_json("value").alias("value"))


def write_values(selected: DataFrame, path: str, mode: str = "errorifexists") -> None:
    as_json_lines(selected).write.mode(mode).text(path)


def stream_values(selected: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends values to a folder of JSON lines; exactly once, as the file sink's log has it."""
    writer = as_json_lines(selected).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def on_rows(selected: DataFrame, listener: Callable[[Row], None], checkpoint: str | None = None) -> StreamingQuery | None:
    """Calls listener on the driver for each row: of a batch at once, of a stream batch by batch. Rows come one partition at a time."""
    each = selected.withColumn("value", F.to_json("value"))
    if not selected.isStreaming:
        for row in each.toLocalIterator():
            listener(row)
        return None

    def batch(df: DataFrame, _: int) -> None:
        for row in df.toLocalIterator():
            listener(row)

    writer = each.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
