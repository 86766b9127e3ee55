"""select(): what a path reaches in the documents of a column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.variant import shallow
from pathloom.operators.recursive import recursive
from pathloom.operators.typed import has_map, typed
from pathloom.operators.udtf import by_udtf
from pathloom.operators.unrolled import ARRAY_DEPTH, unrolled
from pathloom.plans.ast import PathExpr
from pathloom.plans.parser import as_path

STRATEGIES = ("auto", "typed", "unrolled", "recursive", "udtf")


def documents(df: DataFrame, column: str) -> DataFrame:
    """df with its documents as VARIANT in _v, in place of the column. Of a key that is repeated the last value counts."""
    t = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(t, T.StringType):
        df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        v = F.try_parse_json(c)
    elif isinstance(t, T.VariantType):
        v = c
    elif isinstance(t, T.StructType | T.MapType | T.ArrayType):
        v = F.try_parse_json(F.to_json(c))
    else:
        raise TypeError(f"documents can't be of type {t.simpleString()}")
    return df.withColumn("_v", v).drop(column)


def select(
    df: DataFrame,
    column: str,
    path: str | PathExpr,
    *,
    include_array_index: bool = False,
    strategy: str = "auto",
    max_depth: int = 12,
    array_depth: int = 2,
    keep_type: bool = False,
    ordered: bool = False,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row for each node that the path reaches: df's other columns, path, value and kind.

    column: JSON text, VARIANT, struct, array or map. path (of the result): keys from the root on, and with
    include_array_index the positions of elements, as text; positions in a root array are not in it.
    value: VARIANT, or with keep_type (typed columns) the values' own type. kind: object, scalar or null.
    Arrays are never reached themselves; their elements are. Documents that are no JSON give no rows.
    names: other names for path, value, kind and ord, which are needed where df has such columns too.

    strategy: auto (typed for structs and arrays; else unrolled, and documents that are too deep for it by udtf, each
    by itself), typed (plan over the schema), unrolled (a chain of generators of set depth, which raises on what is
    deeper: max_depth levels from the first `*` or `..` on, array_depth arrays directly in each other before, or eight
    where positions aren't asked for), recursive (a recursive query, batch only), udtf (Python: any depth, members in
    the order written).
    ordered: adds ord, an array<int>; within a document it sorts inner nodes before outer ones, elements by
    position, and members by key (as written for udtf, by the schema for typed).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
    compiled = as_path(path)
    kind = df.schema[column].dataType
    unknown = strategy == "auto" and (has_map(kind) or not isinstance(kind, T.StructType | T.ArrayType))
    if strategy == "auto":
        strategy = "unrolled" if unknown else "typed"
    if keep_type and strategy != "typed":
        raise ValueError("only typed selection keeps types")
    result = {c: (names or {}).get(c, c) for c in ("path", "value", "kind", *(["ord"] if ordered else []))}
    own = [c for c in df.columns if c != column]
    if clash := {c.lower() for c in own} & {c.lower() for c in result.values()}:
        raise ValueError(f"df has columns {', '.join(sorted(clash))}; give others by `names`")
    # The plans' own columns can't meet the caller's, whose names are put back at the end.
    inner = df.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(own)), F.col(f"`{column}`").alias("_doc"))
    if strategy == "typed":
        found = typed(inner, "_doc", compiled, index=include_array_index, keep_type=keep_type)
    elif strategy == "udtf":
        found = _in_python(inner, compiled, include_array_index)
    elif strategy == "recursive":
        found = recursive(documents(inner, "_doc"), compiled, index=include_array_index)
    else:
        flat = all(not s.deep and s.test is not None for s in compiled.steps)
        deep = None
        if unknown and not flat:
            limit = (compiled, include_array_index or ordered, max_depth, array_depth)
            deep = _in_python(_made(inner).where(~fits(F.col("_doc"), *limit)), compiled, include_array_index)
            if isinstance(kind, T.StringType):
                inner = _made(inner).where(fits(F.col("_doc"), *limit))
            else:
                inner = inner.where(fits(_as_text(inner), *limit))
        found = unrolled(documents(inner, "_doc"), compiled, index=include_array_index, ordered=ordered, max_depth=max_depth, array_depth=array_depth)
        if deep is not None:
            found = found.unionByName(deep)
    source = {"path": "_shown", "value": "_value", "kind": "_kind", "ord": "_ord"}
    return found.select(*(F.col(f"_o{i}").alias(c) for i, c in enumerate(own)), *(F.col(source[c]).alias(name) for c, name in result.items()))


def _as_text(df: DataFrame) -> Column:
    return F.col("_doc") if isinstance(df.schema["_doc"].dataType, T.StringType) else F.to_json("_doc")


def _made(df: DataFrame) -> DataFrame:
    """df with its documents as text. By a generator, as a plan would make the text anew for each use of it."""
    return df.withColumn("_doc", F.explode(F.array(_as_text(df))))


def _in_python(df: DataFrame, path: PathExpr, index: bool) -> DataFrame:
    return by_udtf(df.withColumn("_v", _as_text(df)).drop("_doc"), path, index=index)


def fits(text: Column, path: PathExpr, positions: bool, max_depth: int, array_depth: int) -> Column:
    """Whether a document is surely within the depth of an unrolled plan. False, never NULL, for a NULL text too."""
    hops = array_depth if positions else max(array_depth, ARRAY_DEPTH)
    known = bool(path.steps) and not path.steps[0].deep and path.steps[0].test is not None
    within = shallow(text, min(max_depth, hops) if known and not positions else max_depth)
    if known and positions:
        # Arrays are counted whatever is between them, which is more than are directly in each other.
        within = within & shallow(F.regexp_replace(text, r"[{}]", ""), hops)
    else:
        within = within & ~text.rlike(rf"\A\s*+(?:\[\s*+){{{hops + 1}}}")
    return F.coalesce(within, F.lit(False))
