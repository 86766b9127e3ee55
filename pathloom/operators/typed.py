"""Selection from structs, arrays and maps: the path runs over the schema when the plan is made.

What it reaches is a finite set of typed places, each a chain of fields and generators. Places behind the same
arrays share one scan and its generators. Catalyst prunes the scan to the fields in use. A field that is NULL is
taken as missing, as typed data don't tell the two apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.unrolled import LAST
from pathloom.plans.ast import All, Condition, Key, Not, PathExpr
from pathloom.plans.matcher import START, accepts, advance

_FIELD, _ITEMS = "field", "items"


@dataclass(frozen=True)
class Place:
    """Hops from the column on: ('field', name, its number in the schema) or ('items', None, 0)."""

    hops: tuple[tuple[str, str | None, int], ...]
    type: T.DataType

    @property
    def arrays(self) -> tuple[tuple, ...]:
        """The hops up to the last array: what generators are needed for."""
        last = max((i for i, (hop, *_) in enumerate(self.hops) if hop == _ITEMS), default=-1)
        return self.hops[: last + 1]


def places(path: PathExpr, schema: T.DataType) -> list[Place]:
    """Inner before outer, in the order of the schema."""
    found: list[Place] = []

    def walk(t: T.DataType, states: int, keys: tuple[str, ...], hops: tuple) -> None:
        if isinstance(t, T.ArrayType):
            walk(t.elementType, states, keys, (*hops, (_ITEMS, None, 0)))
            return
        if isinstance(t, T.StructType):
            for n, f in enumerate(t.fields):
                if after := advance(path, states, keys, f.name):
                    walk(f.dataType, after, (*keys, f.name), (*hops, (_FIELD, f.name, n)))
        if isinstance(t, T.MapType):
            raise TypeError("maps have no keys in the schema")
        if accepts(path, states) and (isinstance(t, T.StructType) or path.scalars):
            found.append(Place(hops, t))

    walk(schema, START, (), ())
    return found


def has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return has_map(t.elementType)
    return isinstance(t, T.MapType) or isinstance(t, T.StructType) and any(has_map(f.dataType) for f in t.fields)


def _has(c: Condition, v: Column, t: T.StructType) -> Column:
    if isinstance(c, Key):
        return v.getField(c.name).isNotNull() if c.name in t.fieldNames() else F.lit(False)
    if isinstance(c, Not):
        return ~_has(c.of, v, t)
    first, *rest = (_has(x, v, t) for x in c.of)
    for x in rest:
        first = first & x if isinstance(c, All) else first | x
    return first


def as_variant(v: Column, t: T.DataType) -> Column:
    if isinstance(t, T.StructType):
        return F.to_variant_object(v)
    if isinstance(t, T.TimestampType | T.DateType | T.BinaryType):
        return v.cast("string").cast("variant")
    return v.cast("variant")


def _opened(df: DataFrame, column: str, hops: tuple) -> tuple[DataFrame, Column, list[Column]]:
    """df with a generator for each array of the hops; the value there, and the positions of its elements."""
    v, out, positions = F.col(column), df, []
    for i, (hop, name, _) in enumerate(hops):
        if hop == _FIELD:
            v = v.getField(name)
        else:
            out = out.select("*", F.posexplode(v).alias(f"_p{i}", f"_e{i}"))
            v = F.col(f"_e{i}")
            positions.append(F.col(f"_p{i}"))
    return out, v, positions


def _at(place: Place, v: Column, positions: list[Column], path: PathExpr, index: bool) -> tuple[dict[str, Column], Column, T.DataType]:
    """What a row has of a place, where it is there, and the type of its value. v: what is behind the place's arrays."""
    shown, order, keys, where = [], [], 0, iter(positions)
    for hop, name, n in place.hops:
        if hop == _FIELD:
            shown.append(F.lit(name))
            order.append(F.lit(n))
            keys += 1
        else:
            order.append(next(where))
            if index and keys:
                shown.append(order[-1].cast("string"))
    for _, name, _ in place.hops[len(place.arrays) :]:
        v = v.getField(name)
    there, t = v.isNotNull(), place.type
    if path.keep is not None:
        there = there & _has(path.keep, v, t)
    if path.drop and isinstance(t, T.StructType):
        names = [f.name for f in t.fields if f.name not in path.drop]
        t = T.StructType([f for f in t.fields if f.name in names])
        v = F.struct(*(v.getField(n).alias(n) for n in names)) if names else F.struct()
    kind = "object" if isinstance(t, T.StructType) else "scalar"
    row = {"_shown": F.array(*shown) if shown else F.array().cast("array<string>"), "_value": v, "_kind": F.lit(kind), "_ord": F.array(*order, F.lit(LAST))}
    return row, there, t


def typed(df: DataFrame, column: str, path: PathExpr, *, index: bool, keep_type: bool) -> DataFrame:
    """keep_type: values have their own type, for which all places must share one; else VARIANT."""
    own = [F.col(f"`{c}`") for c in df.columns if c != column]
    groups: dict[tuple, list[Place]] = {}
    for p in places(path, df.schema[column].dataType):
        groups.setdefault(p.arrays, []).append(p)
    out, types = None, set()
    for hops, group in groups.items():
        opened, v, positions = _opened(df, column, hops)
        found = []
        for p in group:
            row, there, t = _at(p, v, positions, path, index)
            types.add(t.simpleString())
            found.append((row if keep_type else row | {"_value": as_variant(row["_value"], t)}, there))
        if len(found) == 1:
            row, there = found[0]
            part = opened.where(there).select(*own, *(c.alias(n) for n, c in row.items()))
        elif keep_type and len(types) > 1:
            break
        else:
            # One generator over the group's places; a place that isn't there is NULL.
            each = F.array(*(F.when(there, F.struct(*(c.alias(n) for n, c in row.items()))) for row, there in found))
            part = opened.select(*own, F.explode(each).alias("_x")).where("_x IS NOT NULL").select(*own, "_x.*")
        out = part if out is None else out.unionByName(part)
    if keep_type and len(types) != 1:
        raise TypeError(f"{path} reaches values of {len(types)} types, not one: take them as VARIANT")
    if out is None:
        nothing = {"_shown": "CAST(array() AS array<string>)", "_value": "CAST(NULL AS variant)", "_kind": "''", "_ord": "CAST(array() AS array<int>)"}
        return df.where(F.lit(False)).select(*own, *(F.expr(e).alias(n) for n, e in nothing.items()))
    return out
