"""The abstract syntax of a search: boolean nodes over leaf predicates."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Leaf:
    """One predicate: a function name ('' for a bare term), its value and what modifies it.

    items: the elements of a value list, each with its own comparison; any_item: whether one of them is enough.
    """

    fn: str = ""
    value: str = ""
    cmp: str = "="
    mods: frozenset[str] = frozenset()
    items: tuple[tuple[str, str], ...] | None = None
    any_item: bool = False
    nested: object | None = None


@dataclass(frozen=True)
class And:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Or:
    parts: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class MatchAll:
    """The empty search."""


class SearchSyntaxError(ValueError):
    """A search that cannot be read."""
