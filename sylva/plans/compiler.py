"""Compiles a syntax tree to one Catalyst expression, nested searches to joins beside it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.leaves import Context, leaf_predicate
from . import parser
from .tree import And, Leaf, MatchAll, Not, Or

#: Leaves that read a number, a flag or the extension; they stand before text in a conjunction.
CHEAP = frozenset(
    "parent root depth size child-count len file folder directory ext extension type attrib empty dm date-modified dc date-created audio video image picture doc document archive zip exe".split(
    ))


@dataclass
class Compiled:
    predicate: Column
    flags: dict[str, object] = field(default_factory=dict)  # column name -> nested tree, for a left join
    semi: list[object] = field(default_factory=list)  # nested trees that every match needs


def _cost(node) -> int:
    if isinstance(node, Leaf):
        return 0 if node.fn in CHEAP else 1
    if isinstance(node, Not):
        return _cost(node.part)
    return max((_cost(p) for p in getattr(node, "parts", ())), default=0)


def _conjuncts(node) -> list:
    return [x for p in node.parts for x in _conjuncts(p)] if isinstance(node, And) else [node]


def compile_tree(node, ctx: Context) -> Compiled:
    out = Compiled(F.lit(True))

    def column(n) -> Column:
        if isinstance(n, MatchAll):
            return F.lit(True)
        if isinstance(n, Not):
            return ~F.coalesce(column(n.part), F.lit(False))
        if isinstance(n, And | Or):
            parts = [column(p) for p in sorted(n.parts, key=_cost)]
            total = parts[0]
            for p in parts[1:]:
                total = (total & p) if isinstance(n, And) else (total | p)
            return total
        if n.nested is not None:
            name = f"_child{len(out.flags)}"
            out.flags[name] = n.nested
            return F.col(name)
        return leaf_predicate(n, ctx)

    for part in sorted(_conjuncts(node), key=_cost):
        if isinstance(part, Leaf) and part.nested is not None:
            out.semi.append(part.nested)
        else:
            out.predicate = out.predicate & column(part)
    return out


def parents_of(entries: DataFrame, node, ctx: Context) -> DataFrame:
    return matching(entries, node, ctx).filter("parent is not null").select(F.col("parent").alias("_holder")).distinct()


def matching(entries: DataFrame, node, ctx: Context) -> DataFrame:
    """The entries that a tree matches."""
    c = compile_tree(node, ctx)
    x = entries
    for nested in c.semi:
        holders = parents_of(entries, nested, ctx)
        x = x.join(holders, x["id"] == holders["_holder"], "left_semi")
    for name, nested in c.flags.items():
        holders = parents_of(entries, nested, ctx)
        x = x.join(holders, x["id"] == holders["_holder"], "left").withColumn(name, F.col("_holder").isNotNull()).drop("_holder")
    return x.filter(c.predicate).drop(*c.flags)


def matches(entries: DataFrame, text: str, ctx: Context | None = None) -> DataFrame:
    """The entries that a search string matches."""
    return matching(entries, parser.parse(text), ctx or Context())
