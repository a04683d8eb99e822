"""Leaf predicates as Catalyst expressions, by function name.

FUNCTIONS is the extension point: a function from a leaf and a context to a boolean column. A predicate may be
null where a column is (no extension); the compiler makes it false before it negates it, and leaves it bare
elsewhere, so that plain comparisons are pushed down to the scan.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.extensions import MACROS, TYPES
from ..functions.literals import Bounds, Dates, size_bounds
from ..plans.tree import Leaf
from ..sources.catalog import stem

log = logging.getLogger(__name__)

ANCHORS = frozenset("case ww prefix suffix startwith endwith regex path".split())
IGNORES = frozenset("ignorepunc ignorews diacritics".split())


@dataclass
class Context:
    """What a search is read against: the moment, the time zone, the session's match options, warnings so far.

    compat: case: has no effect on plain and whole-word terms, as older clients expect.
    """

    now: int = 0
    zone: tzinfo = UTC
    options: frozenset[str] = frozenset()
    compat: bool = False
    warnings: list[str] = field(default_factory=list)

    def warn(self, message: str) -> None:
        self.warnings.append(message)
        log.warning(message)


def leaf_predicate(leaf: Leaf, ctx: Context) -> Column:
    fn = FUNCTIONS.get(leaf.fn)
    if leaf.items is not None:
        parts = [leaf_predicate(replace(leaf, items=None, value=v, cmp=c), ctx) for c, v in leaf.items]
        out = F.lit(not leaf.any_item) if not parts else parts[0]
        for p in parts[1:]:
            out = (out | p) if leaf.any_item else (out & p)
        return out
    if fn is None:  # an unknown name is text
        return text_match(replace(leaf, fn="", value=f"{leaf.fn}:{leaf.value}"), ctx)
    return fn(leaf, ctx)


def within(c: Column, b: Bounds | None) -> Column:
    if b is None:
        return F.lit(False)
    test = c == b.lo if b.lo == b.hi else (c >= b.lo) & (c <= b.hi)
    return ~test if b.outside else test


def _number(column: str) -> Callable[[Leaf, Context], Column]:
    return lambda leaf, ctx: within(F.col(column), size_bounds(leaf.value, leaf.cmp))


def _date(column: str) -> Callable[[Leaf, Context], Column]:
    return lambda leaf, ctx: within(F.col(column), Dates(ctx.now, ctx.zone).bounds(leaf.value, leaf.cmp))


def normal_path(value: str) -> str:
    value = tx.one_separator(value)
    return value.rstrip("/") or value[:1]


def _parent(leaf: Leaf, ctx: Context) -> Column:
    if not leaf.value:
        return _root(leaf, ctx)
    return F.col("parent").isNotNull() & (F.col("parent_path") == normal_path(leaf.value))


def _root(leaf: Leaf, ctx: Context) -> Column:
    return F.col("depth") == 1


def ext_list(value: str) -> list[str]:
    for sep in ";,":
        value = value.replace(sep, " ")
    out = []
    for e in value.split():
        e = e.removeprefix("*").removeprefix(".")
        if e:
            out.append(tx.folded(e))
    return out


def _one_of(exts: list[str]) -> Column:
    return F.col("ext").isin(exts) if exts else F.lit(False)


def _ext(leaf: Leaf, ctx: Context) -> Column:
    return _one_of(ext_list(leaf.value))


def _type(leaf: Leaf, ctx: Context) -> Column:
    name = leaf.value.strip().lower()
    if name in TYPES:
        return _one_of(TYPES[name])
    return _one_of(ext_list(leaf.value)) if any(c in leaf.value for c in ";,") else F.lit(False)


def _attrib(leaf: Leaf, ctx: Context) -> Column:
    value = leaf.value.lower()
    if leaf.cmp == "!=":
        value = "!" + value
    tests, negate = [], False
    for c in value:
        if c in "!-":
            negate = True
        elif c in "hd":
            test = F.col("is_hidden" if c == "h" else "is_dir")
            tests.append(~test if negate else test)
            negate = False
        else:
            ctx.warn(f"attribute {c!r} is not known")
            negate = False
    if not tests:
        return F.lit(False)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _empty(leaf: Leaf, ctx: Context) -> Column:
    return F.when(F.col("is_dir"), F.col("nchild") == 0).otherwise(F.col("size") == 0)


def modifiers(leaf: Leaf, ctx: Context) -> frozenset[str]:
    """The leaf's own match options, else the session's; ignored characters add up."""
    own = leaf.mods if leaf.mods & ANCHORS else leaf.mods | (ctx.options & ANCHORS)
    return own | (ctx.options & IGNORES)


def text_match(leaf: Leaf, ctx: Context) -> Column:
    """One text predicate; the tests stand in order of precedence, the first that applies decides."""
    mods, value = modifiers(leaf, ctx), leaf.value
    mods = mods | ({leaf.fn} & {"regex", "whole", "ww", "startwith", "endwith", "prefix", "suffix"})
    case = "case" in mods
    by_path = "path" in mods or leaf.fn in ("path", "path-part") or (("/" in value or "\\" in value) and "regex" not in mods)
    subject = F.col("path") if by_path else F.col("dname")
    if by_path and "regex" not in mods:
        value = tx.one_separator(value)
    if leaf.fn == "stem":
        subject = stem(subject)
    if "regex" in mods:
        pattern = tx.regex_for_java(value, case)
        if pattern is None:
            ctx.warn(f"the pattern {value!r} cannot be used")
            return F.lit(False)
        found = tx.regex_match(subject, pattern)
        return found | tx.regex_match(F.translate(subject, "/", "\\"), pattern) if by_path and "\\" in value else found
    if mods & IGNORES:
        a, b = tx.normalised(subject, mods), tx.normalised_text(value, mods)
        return F.contains(a, F.lit(b)) if case and not ctx.compat else F.contains(tx.fold(a), F.lit(tx.folded(b)))
    if tx.has_wildcard(value) and "whole" not in mods:
        return tx.wildcard(subject, value, by_path, case)
    if "whole" in mods:
        return tx.wildcard(subject, value, by_path, case) if tx.has_wildcard(value) else subject == value
    a, b = (subject, value) if case else (tx.fold(subject), tx.folded(value))
    flags, literal = "(?s)" if case else "(?is)", tx.quoted(value)
    if "startwith" in mods:
        return F.startswith(a, F.lit(b))
    if "endwith" in mods:
        return F.endswith(a, F.lit(b))
    if "prefix" in mods:
        return subject.rlike(f"{flags}\\A{literal}(?!{tx.WORD})")
    if "suffix" in mods:
        return subject.rlike(f"{flags}(?<!{tx.WORD}){literal}\\z")
    if ctx.compat:
        a, b, flags = tx.fold(subject), tx.folded(value), "(?is)"
    if "ww" in mods:
        return subject.rlike(f"{flags}(?<!{tx.WORD}){literal}(?!{tx.WORD})") if value else F.lit(True)
    return F.contains(a, F.lit(b))


def _macro(exts: list[str]) -> Callable[[Leaf, Context], Column]:
    return lambda leaf, ctx: _one_of(exts)


def _unsupported(leaf: Leaf, ctx: Context) -> Column:
    ctx.warn(f"{leaf.fn}: is not available here")
    return F.lit(False)


FUNCTIONS: dict[str, Callable[[Leaf, Context], Column]] = {
    "parent": _parent, "root": _root, "depth": _number("depth"), "size": _number("size"), "child-count": _number("nchild"),
    "len": lambda leaf, ctx: within(F.octet_length("name"), size_bounds(leaf.value, leaf.cmp)),
    "file": lambda leaf, ctx: ~F.col("is_dir"), "folder": lambda leaf, ctx: F.col("is_dir"), "directory": lambda leaf, ctx: F.col("is_dir"),
    "ext": _ext, "extension": _ext, "type": _type, "attrib": _attrib, "empty": _empty,
    "dm": _date("mtime"), "date-modified": _date("mtime"), "dc": _date("ctime"), "date-created": _date("ctime"),
    **{name: _macro(exts) for name, exts in MACROS.items()},
    **{name: text_match for name in ("", "name", "name-part", "path", "path-part", "stem", "regex", "whole", "ww", "startwith", "endwith", "prefix", "suffix")},
}
#: Functions that are known and answer nothing.
UNSUPPORTED = "content dupe filelist filelist-filename si index-type run-count frn album artist title genre comment tag track length width height bitdepth orientation star-rating child-file-count child-folder-count".split(
    )
FUNCTIONS.update(dict.fromkeys(UNSUPPORTED, _unsupported))
