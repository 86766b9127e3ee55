"""Selection in Python, where order within objects matters or documents are of any depth.

The slow way: each document is parsed and walked in a Python worker, without recursion. It keeps the order of members as
written, which VARIANT does not. A value that is nested deeper than a VARIANT can be is NULL; its path and kind are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.plans.ast import PathExpr
from pathloom.plans.jsontext import SyntaxFault, dumps, loads
from pathloom.plans.matcher import select_values


def _kind(value: object) -> str:
    return "object" if isinstance(value, dict) else "null" if value is None else "scalar"


def by_udtf(df: DataFrame, path: PathExpr, *, index: bool) -> DataFrame:
    """df has _v, as JSON text. Numbers keep the digits they are written with; bad documents give nothing."""

    @F.udtf(returnType="_shown array<string>, _json string, _kind string, _n int")
    class Selected:
        def eval(self, text: str):
            if text is None:
                return
            try:
                document = loads(text)
            except SyntaxFault:
                return
            for n, (keys, value) in enumerate(select_values(path, document, index)):
                yield keys, dumps(value), _kind(value), n

    out = df.lateralJoin(Selected(F.col("_v").outer()))
    out = out.withColumn("_value", F.try_parse_json("_json")).withColumn("_ord", F.array("_n"))
    return out.drop("_json", "_n", "_v")
