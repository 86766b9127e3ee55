"""Paths from calls instead of text; keys can then hold any character."""

from __future__ import annotations

from collections.abc import Iterable

from pathloom.plans.ast import Condition, Key, PathExpr, Some, Step
from pathloom.plans.parser import parse_condition


def _condition(given: str | Condition | Iterable[str] | None) -> Condition | None:
    """Text is parsed; several keys mean any of them."""
    if given is None or isinstance(given, Condition):
        return given
    if isinstance(given, str):
        return parse_condition(given)
    names = tuple(Key(k) for k in given)
    return names[0] if len(names) == 1 else Some(names)


class PathBuilder:
    """child(), wildcard() and descendant() add to the path; build() gives it and starts anew."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self._steps: list[Step] = []
        self._deep = False
        self._keep: Condition | None = None
        self._drop: tuple[str, ...] = ()

    def child(self, key: str, where: str | Condition | Iterable[str] | None = None) -> PathBuilder:
        self._steps.append(Step(key, self._deep, _condition(where)))
        self._deep = False
        return self

    def wildcard(self, where: str | Condition | Iterable[str] | None = None) -> PathBuilder:
        self._steps.append(Step(None, self._deep, _condition(where)))
        self._deep = False
        return self

    def descendant(self) -> PathBuilder:
        """The next step may skip keys; said twice it means the same."""
        self._deep = True
        return self

    def keep(self, having: str | Condition | Iterable[str]) -> PathBuilder:
        self._keep = _condition(having)
        return self

    def drop(self, *keys: str) -> PathBuilder:
        self._drop = keys
        return self

    def build(self) -> PathExpr:
        if self._deep:
            raise ValueError("a path can't end with a descendant")
        found = PathExpr(tuple(self._steps), self._keep, self._drop)
        self._reset()
        return found
