"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1). BENCH_CPUS: cores. Each query is run once to warm up and
timed on the second run; its rows are counted through the noop sink, so all columns are made. The selections
over documents read JSON text that is prepared before the clock starts, as Parquet, or where they are named so as gzipped
lines or as one file that is an array.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="pathloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from pathloom import read_documents, select
    from pathloom.queries import events_props, order_documents, order_texts

    order_documents(spark, d).repartition(int(cpus)).write.parquet(f"{shared}/orders-typed")
    order_texts(spark, d).repartition(int(cpus)).write.parquet(f"{shared}/orders-text")
    small = spark.range(0, 1_000_000, numPartitions=int(cpus)).select("id", F.concat(F.lit('{"field1": "some text", "field2": {"nested": '), F.col("id").cast("string"), F.lit('}, "field3": [1, 2]}')).alias("doc"))
    small.write.parquet(f"{shared}/small")
    # As the published sets are: gzipped lines of small objects, gzipped lines of objects of about 5 KB, and these as one array.
    small.select("doc").write.option("compression", "gzip").text(f"{shared}/small-lines")
    filler = F.repeat(F.sha2(F.col("id").cast("string"), 256), F.lit(75))
    plugins = F.concat(F.lit('{"plugins": [{"name": "p'), F.col("id").cast("string"), F.lit('", "version": 1}, {"name": "q"}], "text": "'), filler, F.lit('"}'))
    large = spark.range(0, 40_000, numPartitions=int(cpus)).select("id", F.concat(F.lit('{"_id": "'), F.col("id").cast("string"), F.lit('", "_source": {"name": "x", "build": '), plugins, F.lit("}}")).alias("doc"))
    large.select("doc").write.option("compression", "gzip").text(f"{shared}/large-lines")
    array = large.select(F.concat("doc", F.lit(",")).alias("doc"), F.lit(1).alias("n")).unionByName(spark.createDataFrame([("[", 0), ("null]", 2)], "doc string, n int"))
    array.repartition(1).sortWithinPartitions("n").select("doc").write.text(f"{shared}/large-array")
    typed, texts = (lambda: spark.read.parquet(f"{shared}/orders-typed")), (lambda: spark.read.parquet(f"{shared}/orders-text"))

    queries = {
        "events_props": lambda: events_props(spark, d),
        "small_child_1m": lambda: select(spark.read.parquet(f"{shared}/small"), "doc", "$.field2.nested"),
        "gzip_lines_child_1m": lambda: select(read_documents(spark, f"{shared}/small-lines").select("text"), "text", "$.field2.nested"),
        "gzip_lines_descendant_5kb_40k": lambda: select(read_documents(spark, f"{shared}/large-lines").select("text"), "text", "$..plugins"),
        "array_descendant_5kb_40k": lambda: select(read_documents(spark, f"{shared}/large-array", "array").select("text"), "text", "$..plugins"),
        "text_child": lambda: select(texts(), "doc", "$.order.lines.qty"),
        "text_descendant": lambda: select(texts(), "doc", "$..rate"),
        "text_filter": lambda: select(texts(), "doc", "$..[order && lines]qty"),
        "text_presence": lambda: select(texts(), "doc", "$..lines{promo && big}"),
        "typed_child": lambda: select(typed(), "doc", "$.order.lines.qty", keep_type=True),
        "typed_descendant": lambda: select(typed(), "doc", "$..rate", keep_type=True),
    }
    try:
        from pathloom.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    queries |= {name: (lambda f=f: f(spark, d)) for name, f in QUERIES.items()}

    took: dict[str, float] = {}
    for name, query in queries.items():
        for _ in range(2):
            began = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total time of the headline queries, second run", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d)}))


if __name__ == "__main__":
    main()
