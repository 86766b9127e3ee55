"""What a path reaches, in plain Python: an automaton over keys.

State i of n + 1: i steps are taken. A set of states is an int of bits, so that plans can carry it as a
column. Array positions change nothing: they are no keys. State n is dropped by the next key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pathloom.plans.ast import PathExpr, Step, holds

START = 1


def advance(path: PathExpr, states: int, above: Sequence[str], key: str) -> int:
    """States after one more key; above: the keys before it."""
    out = 0
    for i, step in enumerate(path.steps):
        if states >> i & 1:
            if step.deep:
                out |= 1 << i
            if (step.test is None or step.test == key) and holds(step.filter, lambda k: k in above):
                out |= 2 << i
    return out


def accepts(path: PathExpr, states: int) -> bool:
    return bool(states >> len(path.steps) & 1)


def matches_keys(path: PathExpr, keys: Sequence[str]) -> bool:
    states = START
    for i, key in enumerate(keys):
        states = advance(path, states, keys[:i], key)
    return accepts(path, states)


def covers(pattern: PathExpr, path: PathExpr) -> bool:
    """Whether pattern reaches what path names. A `*` in path is no key: only `*` covers it. A `..` in path isn't covered by a single key."""
    states, above = START, []
    for step in path.steps:
        taken = 0
        for i, own in enumerate(pattern.steps):
            if states >> i & 1:
                if own.deep:
                    taken |= 1 << i
                fits = own.test is None or own.test == step.test
                if fits and (own.deep or not step.deep) and holds(own.filter, lambda k: k in above):
                    taken |= 2 << i
        states = taken
        if step.test is not None:
            above = [*above, step.test]
    return accepts(pattern, states)


def _leaf(path: PathExpr, value: Any) -> tuple[bool, Any]:
    if isinstance(value, dict):
        if not holds(path.keep, value.__contains__):
            return False, None
        return True, {k: v for k, v in value.items() if k not in path.drop} if path.drop else value
    return path.scalars, value


def select_values(path: PathExpr, document: Any, with_index: bool = False) -> Iterator[tuple[list[str], Any]]:
    """(keys, value) of all that path reaches in a parsed document, inner before outer; root arrays are opened."""

    def inside(value: Any, states: int, keys: tuple[str, ...], shown: tuple[str, ...]) -> Iterator[tuple]:
        if isinstance(value, list):
            for i, x in enumerate(value):
                yield x, states, keys, (*shown, str(i)) if with_index and keys else shown
        elif isinstance(value, dict):
            for k, x in value.items():
                if after := advance(path, states, keys, k):
                    yield x, after, (*keys, k), (*shown, k)

    # Nodes that are open, each with what is left of its members. Scalars have none.
    root = (document, START, (), ())
    stack = [(root, inside(*root))]
    while stack:
        (value, states, _, shown), rest = stack[-1]
        for member in rest:
            if isinstance(member[0], dict | list):
                stack.append((member, inside(*member)))
                break
            if path.scalars and accepts(path, member[1]):
                yield list(member[3]), member[0]
        else:
            stack.pop()
            if not isinstance(value, list) and accepts(path, states):
                wanted, found = _leaf(path, value)
                if wanted:
                    yield list(shown), found


__all__ = ["START", "Step", "accepts", "advance", "covers", "matches_keys", "select_values"]
