"""A compiled path: steps from the document's root, and what is done with what they reach.

A step goes down one key (axis `.`) or any number of keys and then one (axis `..`). Its test is a key or,
as None, any key. Its filter is a condition on the keys above the one it binds. `keep` is a condition on
the keys of the object reached, `drop` are keys that it loses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Key:
    name: str


@dataclass(frozen=True)
class Not:
    of: Condition


@dataclass(frozen=True)
class All:
    of: tuple[Condition, ...]


@dataclass(frozen=True)
class Some:
    of: tuple[Condition, ...]


Condition = Key | Not | All | Some


def keys_of(c: Condition | None) -> tuple[str, ...]:
    """Keys that a condition names, in order, each once."""
    if c is None:
        return ()
    if isinstance(c, Key):
        return (c.name,)
    inner = (c.of,) if isinstance(c, Not) else c.of
    return tuple(dict.fromkeys(k for x in inner for k in keys_of(x)))


def holds(c: Condition | None, has: Callable[[str], bool]) -> bool:
    if c is None:
        return True
    if isinstance(c, Key):
        return has(c.name)
    if isinstance(c, Not):
        return not holds(c.of, has)
    return (all if isinstance(c, All) else any)(holds(x, has) for x in c.of)


def render(c: Condition) -> str:
    if isinstance(c, Key):
        return c.name
    if isinstance(c, Not):
        return f"!{render(c.of)}" if isinstance(c.of, Key) else f"!({render(c.of)})"
    inner = (f"({render(x)})" if isinstance(x, All | Some) else render(x) for x in c.of)
    return (" && " if isinstance(c, All) else " || ").join(inner)


@dataclass(frozen=True)
class Step:
    test: str | None
    deep: bool = False
    filter: Condition | None = None

    def __str__(self) -> str:
        filtered = f"[{render(self.filter)}]" if self.filter else ""
        return f"{'..' if self.deep else '.'}{filtered}{'*' if self.test is None else self.test}"


@dataclass(frozen=True)
class PathExpr:
    steps: tuple[Step, ...] = ()
    keep: Condition | None = None
    drop: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.keep is not None and self.drop:
            raise ValueError("a path has either a condition on keys or keys to drop")

    def __str__(self) -> str:
        leaf = f"{{{render(self.keep)}}}" if self.keep else f"<{' '.join(self.drop)}>" if self.drop else ""
        return "$" + "".join(map(str, self.steps)) + leaf

    @property
    def definite(self) -> bool:
        """Whether no step skips keys; the depth of what it reaches is then known."""
        return not any(s.deep for s in self.steps)

    @property
    def minimum_depth(self) -> int:
        """Least count of places from the root, itself counted, to what is reached."""
        return 1 + len(self.steps)

    @property
    def keep_keys(self) -> tuple[str, ...]:
        return keys_of(self.keep)

    @property
    def scalars(self) -> bool:
        """Whether it can reach anything but objects: never under a condition on keys, nor at the root."""
        return self.keep is None and bool(self.steps)
