"""Text predicates as Catalyst expressions: folding, wildcards, regular expressions, normalisation."""

from __future__ import annotations

import re
import string
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: A letter, a digit or anything beyond ASCII: what a word is made of. The underscore is a boundary.
WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
_FOLD = str.maketrans(UPPER, LOWER)


def fold(c: Column) -> Column:
    """ASCII letters in lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def folded(s: str) -> str:
    return s.translate(_FOLD)


def quoted(s: str) -> str:
    """s as a literal within a Java regular expression."""
    return re.sub(r"([^A-Za-z0-9\x80-\U0010FFFF\s])", r"\\\1", s)


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that are a base letter with marks, and their bases."""
    marked, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(code))
        if len(d) > 1 and d[0] in string.ascii_letters and all(unicodedata.combining(x) for x in d[1:]):
            marked.append(chr(code))
            base.append(d[0])
    return "".join(marked), "".join(base)


MARKED, BASE = _accents()
_UNMARK = str.maketrans(MARKED, BASE)


def normalised(c: Column, mods: frozenset[str]) -> Column:
    if "diacritics" in mods:
        c = F.translate(c, MARKED, BASE)
    gone = (string.punctuation if "ignorepunc" in mods else "") + (string.whitespace if "ignorews" in mods else "")
    return F.translate(c, gone, "") if gone else c


def normalised_text(s: str, mods: frozenset[str]) -> str:
    if "diacritics" in mods:
        s = s.translate(_UNMARK)
    gone = (string.punctuation if "ignorepunc" in mods else "") + (string.whitespace if "ignorews" in mods else "")
    return "".join(ch for ch in s if ch not in gone)


def one_separator(value: str) -> str:
    """Any run of slashes and backslashes as one slash."""
    return re.sub(r"[/\\]+", "/", value)


def resolve_path(cwd: str, path: str) -> str:
    """path seen from cwd, with one kind of separator and without . and .. components."""
    parts: list[str] = []
    for part in one_separator(path if path[:1] in ("/", "\\") else f"{cwd}/{path}").split("/"):
        if part == "..":
            del parts[-1:]
        elif part not in ("", "."):
            parts.append(part)
    return "/" + "/".join(parts)


def has_wildcard(value: str) -> bool:
    return any(c in value for c in "*?#[]")


def wildcard_body(pattern: str) -> str | None:
    """A wildcard pattern as a regular expression; None if it can match nothing (an open bracket)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        last = i == len(pattern) - 1
        if c == "*":
            if pattern[i : i + 2] == "**":
                out.append(".*")
                i += 1
            else:
                out.append(r"[^/\\]*")
        elif c == "?":
            out.append(r"[^/\\]")
        elif c == "#":
            out.append("[0-9]")
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] not in "!^" else i + 3)
            if end < 0:
                return None
            inner = pattern[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^~])", r"\\\1", inner[1:] if negated else inner)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c in "/\\" and last:
            out.append(r"[/\\]?")
        elif c == "\\":
            i += 1
            out.append(quoted(pattern[i]))
        elif c == "/":
            out.append(r"[/\\]")
        else:
            out.append(quoted(c))
        i += 1
    return "".join(out)


def wildcard(subject: Column, pattern: str, by_path: bool, case: bool) -> Column:
    flags = "(?s)" if case else "(?is)"
    if by_path and pattern.startswith("*"):
        rest = pattern.lstrip("*")
        tail = rest.rstrip("*")
        if not has_wildcard(tail):  # *text* is found anywhere in the path, *text at its end
            test = lambda c, v: F.contains(c, F.lit(v)) if tail != rest else F.endswith(c, F.lit(v))
            return test(subject, tail) if case else test(fold(subject), folded(tail))
    body = wildcard_body(pattern)
    if body is None:
        return F.lit(False)
    start = r"(?:\A|(?<=[/\\])|(?=[/\\]))" if by_path else r"\A"
    return subject.rlike(f"{flags}{start}{body}\\z")


_UNSUPPORTED = re.compile(r"\\[1-9]|\(\?(?!:|i\))|(?<!\\)(?:\\\\)*\{")


def regex_for_java(pattern: str, case: bool) -> str | None:
    """The pattern as a Java one, or None if it is outside the supported subset or broken."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return None
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]" and out[-1] not in ("[", "[^"):
                inside = False
            elif c == "[" or (c == "&" and pattern[i + 1 : i + 2] == "&") or c == "]":
                c = "\\" + c
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "^":
                c, i = "[^", i + 1
        out.append(c)
        i += 1
    plain = re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern)
    if inside or _UNSUPPORTED.search(plain):
        return None
    try:
        re.compile(re.sub(r"(?<!^)\(\?i\)", "", pattern))
    except re.error:
        return None
    return ("(?md)" if case else "(?imd)") + "".join(out)


def backtracks(pattern: str) -> bool:
    """Whether a matcher that backtracks may take very many steps: a repeat of a group that repeats or chooses within,
    or three unbounded repeats."""
    groups, total, i = [False], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            i = end if end > 0 else len(pattern)
        elif c == "(":
            groups.append(False)
        elif c == "|":
            groups[-1] = True
        elif c == ")" and len(groups) > 1:
            inner = groups.pop()
            groups[-1] |= inner
            if inner and pattern[i + 1 : i + 2] in ("*", "+"):
                return True
        elif c in "*+":
            groups[-1], total = True, total + 1
        i += 1
    return total > 2


def regex_match(subject: Column, pattern: str) -> Column:
    """Whether a pattern of regex_for_java() is found. A pattern that backtracks() goes to a matcher of linear time, by
    Arrow batches; it folds the case of all letters, not of a to z alone."""
    if not backtracks(pattern.partition(")")[2]):
        return subject.rlike(pattern)

    @F.arrow_udf("boolean")
    def found(names: pa.Array) -> pa.Array:
        return pc.match_substring_regex(names, pattern.replace("d)", ")", 1))

    return found(subject)
