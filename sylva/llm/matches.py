"""Rewriting the matches of a pattern within texts by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str) -> Column:
    """An array of (before, match, after): each match with the text up to the match before and after it."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def zipped(p: Column, m: Column) -> Column:
        return F.transform(m, lambda x, i: F.struct(F.get(p, i).alias("before"), x.alias("match"), F.get(p, i + 1).alias("after")))

    return let(F.struct(pieces.alias("p"), matches.alias("m")), lambda s: zipped(s["p"], s["m"]))


def joined(hits: Column, replacement: Column) -> Column:
    """The text of found() anew, with replacement (an array of strings) in place of the matches."""
    parts = F.zip_with(hits, replacement, lambda h, r: F.concat(h["before"], r))
    return F.concat(F.array_join(parts, ""), F.element_at(hits, -1)["after"])
