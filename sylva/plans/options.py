"""Which optional indexes a catalog does without: they change how a search is answered, never what it answers."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass

log = logging.getLogger(__name__)

#: Optional parts: the trigram postings, the stored enriched entries, the cached rows of a session.
INDEXES = ("trigram", "materialised", "cache")
VARIABLE = "SYLVA_SKIP"


@dataclass(frozen=True)
class Skipped:
    names: frozenset[str]
    source: str

    def uses(self, name: str) -> bool:
        return name not in self.names


def read(text: str) -> frozenset[str]:
    """The names in a list like "trigram,cache"; unknown ones are warned of and left out, "none" and "" skip nothing."""
    names = {n.strip().lower() for n in text.replace(",", " ").split()} - {"none"}
    if "all" in names:
        return frozenset(INDEXES)
    for n in sorted(names - set(INDEXES)):
        log.warning("there is no optional index %r", n)
    return frozenset(names & set(INDEXES))


def skipped(flag: str | None = None, sidecar: str | None = None) -> Skipped:
    """What is skipped, by the first that says so: a flag, the text of the options file beside a snapshot, the
    environment; by default nothing."""
    for source, text in (("flag", flag), ("options file", sidecar), ("environment", os.environ.get(VARIABLE))):
        if text is not None:
            return Skipped(read(text), source)
    return Skipped(frozenset(), "default")
