"""Columns over VARIANT values, and the SQL text that plans are made of."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.plans.ast import All, Condition, Key, Not, PathExpr
from pathloom.plans.parser import as_path, parse_condition


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names(keys: Iterable[str]) -> str:
    return f"array({', '.join(map(literal, keys))})"


def member(v: str, key: str) -> str:
    """SQL: an object's value under a key, as VARIANT; NULL if it isn't an object or lacks the key. JSON null is not NULL."""
    if not plain_keys([key]):
        return f"element_at(try_cast({v} AS map<string, variant>), {literal(key)})"
    return descend(v, [key])


def plain_keys(keys: Iterable[str]) -> bool:
    """Whether keys can stand in a path of variant_get."""
    return all(k and not set(k) & set("'\\\"") for k in keys)


def descend(v: str, keys: Iterable[str]) -> str:
    """SQL: what is under keys, one in the other; NULL if any is lacking, or an array lies between. Keys are plain ones."""
    return f"variant_get({v}, {literal('$' + ''.join(f"['{k}']" for k in keys))}, 'variant')"


def is_array(v: str) -> str:
    """SQL: whether v is an array that isn't empty; NULL if it is none. None of its elements is copied; variant_get leaves by an exception where it finds nothing."""
    return f"(size(try_cast({v} AS array<struct<>>)) > 0)"


def is_object(v: str) -> str:
    """SQL: whether v is an object. None of its members is copied."""
    return f"(try_cast({v} AS struct<>) IS NOT NULL)"


def kind_of(v: str) -> str:
    """SQL: 'null', 'array', 'object' or 'scalar'. Reads the value's first level only."""
    return f"CASE WHEN is_variant_null({v}) THEN 'null' WHEN try_cast({v} AS array<variant>) IS NOT NULL THEN 'array' WHEN try_cast({v} AS map<string, variant>) IS NOT NULL THEN 'object' ELSE 'scalar' END"


def shallow(text: Column, depth: int) -> Column:
    """Whether a JSON text has at most `depth` objects and arrays in each other. One pass by a pattern that never goes back."""
    between = r'[^\[\]{}"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^\[\]{}"]*+)*+'
    nested = rf"[\[{{]{between}[\]}}]"
    for _ in range(depth - 1):
        nested = rf"[\[{{]{between}(?:{nested}{between})*+[\]}}]"
    return text.rlike(rf"(?s)\A{between}(?:{nested}{between})*+\z")


def condition(c: Condition, atom) -> str:
    """SQL of a condition; atom gives that of a key."""
    if isinstance(c, Key):
        return atom(c.name)
    if isinstance(c, Not):
        return f"(NOT {condition(c.of, atom)})"
    return "(" + (" AND " if isinstance(c, All) else " OR ").join(condition(x, atom) for x in c.of) + ")"


def presence(c: Condition, v: str) -> str:
    return condition(c, lambda k: f"({member(v, k)} IS NOT NULL)")


def without(keys: Iterable[str], v: str) -> str:
    """SQL: an object without some keys of its first level; anything else as it is."""
    left = f"to_variant_object(map_filter(try_cast({v} AS map<string, variant>), (k, x) -> NOT array_contains({names(keys)}, k)))"
    return f"CASE WHEN try_cast({v} AS map<string, variant>) IS NULL THEN {v} ELSE {left} END"


def advanced(path: PathExpr, states: str, above: str, key: str) -> str:
    """SQL of the automaton: the states (bits of an int) after one more key, with the array of keys above it."""
    terms = []
    for i, step in enumerate(path.steps):
        if step.deep:
            terms.append(f"({states} & {1 << i})")
        test = [f"({states} & {1 << i}) <> 0"]
        if step.test is not None:
            test.append(f"{key} = {literal(step.test)}")
        if step.filter is not None:
            test.append(condition(step.filter, lambda k: f"array_contains({above}, {literal(k)})"))
        terms.append(f"CASE WHEN {' AND '.join(test)} THEN {2 << i} ELSE 0 END")
    return " | ".join(terms) or "0"


# Public columns


def kind(v: Column | str) -> Column:
    """'object', 'array', 'scalar' or 'null' (JSON null)."""
    v = F.col(v) if isinstance(v, str) else v
    as_map, as_list = v.try_cast("map<string, variant>"), v.try_cast("array<variant>")
    return F.when(F.is_variant_null(v), "null").when(as_list.isNotNull(), "array").when(as_map.isNotNull(), "object").when(v.isNotNull(), "scalar")


def has_keys(v: Column | str, having: str | Condition) -> Column:
    """Whether an object has keys, as a condition such as `a && !b`; false for anything else."""
    v = F.col(v) if isinstance(v, str) else v
    as_map = v.try_cast("map<string, variant>")

    def build(c: Condition) -> Column:
        if isinstance(c, Key):
            return F.map_contains_key(as_map, c.name)
        if isinstance(c, Not):
            return ~build(c.of)
        first, *rest = map(build, c.of)
        for x in rest:
            first = first & x if isinstance(c, All) else first | x
        return first

    return F.coalesce(build(parse_condition(having) if isinstance(having, str) else having), F.lit(False))


def drop_keys(v: Column | str, *keys: str) -> Column:
    """An object without some keys of its first level; anything else as it is."""
    v = F.col(v) if isinstance(v, str) else v
    as_map = v.try_cast("map<string, variant>")
    return F.when(as_map.isNull(), v).otherwise(F.to_variant_object(F.map_filter(as_map, lambda k, _: ~k.isin(list(keys)))))


def keys_match(keys: Column | str, path: str | PathExpr) -> Column:
    """Whether a column of key lists (arrays of strings, no indices) is what a path reaches: the automaton, folded over the list."""
    found = as_path(path)
    keys = F.col(keys) if isinstance(keys, str) else keys
    n = len(found.steps)

    def has(c: Condition, above: Column) -> Column:
        if isinstance(c, Key):
            return F.array_contains(above, c.name)
        if isinstance(c, Not):
            return ~has(c.of, above)
        first, *rest = (has(x, above) for x in c.of)
        for x in rest:
            first = first & x if isinstance(c, All) else first | x
        return first

    def step(acc: Column, key: Column) -> Column:
        states = F.lit(0)
        for i, s in enumerate(found.steps):
            here = acc["s"].bitwiseAND(1 << i)
            if s.deep:
                states = states.bitwiseOR(here)
            test = here != 0
            if s.test is not None:
                test = test & (key == s.test)
            if s.filter is not None:
                test = test & has(s.filter, acc["above"])
            states = states.bitwiseOR(F.when(test, F.lit(2 << i)).otherwise(F.lit(0)))
        return F.struct(states.alias("s"), F.concat(acc["above"], F.array(key)).alias("above"))

    start = F.struct(F.lit(1).alias("s"), F.array().cast("array<string>").alias("above"))
    return F.aggregate(keys, start, step, lambda acc: acc["s"].bitwiseAND(1 << n) != 0)
