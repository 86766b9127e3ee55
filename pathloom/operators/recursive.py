"""Selection from VARIANT values of any depth, in batch: a recursive query over their members.

Each round opens LEVELS levels, as those of unrolled(), and keeps only what is reached and what is left to open: rounds are
written to disk, and a document of no more levels leaves nothing there but what is reached.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pathloom.operators.unrolled import ALIVE, LAST_ORD, OPENED, OPENS, _finished, moved, ways
from pathloom.plans.ast import PathExpr

LEVELS = 6


def recursive(df: DataFrame, path: PathExpr, *, index: bool) -> DataFrame:
    """As unrolled(), but no depth is set. Lifts the session's limits on recursion; streams have no such query."""
    if df.isStreaming:
        raise ValueError("a stream can't be read recursively; take strategy 'unrolled' or 'udtf'")
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "10000")
    view = f"_documents_{uuid.uuid4().hex}"
    df.where("_v IS NOT NULL").createOrReplaceTempView(view)
    own = [f"`{c}`" for c in df.columns if c != "_v"]

    def row(**columns: str) -> str:
        names = ("_v", "_s", "_path", "_shown", "_ord", "_k")
        return ", ".join([*own, *(f"{columns[n]} AS {n}" if n in columns else n for n in names)])

    def told(rows: str) -> str:
        return f"SELECT {row(_ord=LAST_ORD, _k='_way')} FROM (SELECT *, explode({ways(path)}) AS _way FROM ({rows}))"

    def opened(rows: str) -> str:
        for _ in range(LEVELS):
            members = f"SELECT r.*, e.* FROM ({rows}) r, LATERAL variant_explode_outer({OPENS}) AS e(_pos, _key, _value) WHERE {OPENED}"
            rows = told(f"SELECT * FROM (SELECT {row(**moved(path, index))} FROM ({members})) WHERE {ALIVE}")
        # What is reached is not asked again for the keys above it.
        return f"SELECT {row(_path='CASE WHEN _k = 0 THEN _path END')} FROM ({rows})"

    root = row(_s="1", _path="CAST(array() AS array<string>)", _shown="CAST(array() AS array<string>)", _ord="CAST(array() AS array<int>)", _k="0")
    walk = f"""
        WITH RECURSIVE w AS ({opened(told(f"SELECT {root} FROM {view}"))} UNION ALL {opened("SELECT * FROM w WHERE _k = 0")})
        SELECT {", ".join([*own, "_v", "_shown", "_ord", "_k"])} FROM w WHERE _k > 0
    """
    found = spark.sql(walk)
    spark.catalog.dropTempView(view)
    return _finished(found, path)
