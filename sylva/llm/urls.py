"""URL filters: longest-fitting host and path rules, else a weighted vocabulary found by Aho-Corasick.

A term counts where no letter or digit stands next to it on either side. Strict terms weigh 1 or more, soft terms
less, 1 / SOFT_LIMIT by default, once for each distinct one: a url whose weight reaches 1 is blocked. The vocabulary is a
parameter: pairs of term and weight, or a table of them (vocabulary()); the default is a short list by subject.

Null urls and urls without :// have an empty host and path and fit no rule; a null url is allowed. Terms are
compared without regard to the case of A to Z; empty ones are left out, and of repeated ones the greatest weight counts.
Repeated rows are judged alike. Empty table: empty result. Other columns stay; columns named like the results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SOFT_LIMIT = 2
#: Terms that a vocabulary may have: the automaton is built in each task.
MOST_TERMS = 500_000
#: The default vocabulary, by subject.
STRICT = tuple(
    "casino porn xxx escort escorts hentai camgirls sexcam viagra cialis tramadol xanax-online warez keygen spam-farm link-farm cheap-pills"
    " online-pharmacy payday-loans replica-watches free-porn sex-chat torrentz piratebay crackz".split()
)
SOFT = tuple(
    "adult nude sex sexy erotic webcam dating hot bet bets betting gambling poker roulette slots jackpot lottery bingo pill pills pharmacy steroids weight-loss"
    " crack cracked torrent torrents serial nulled leaked loan loans debt credit-score forex bitcoin-bonus bonus buy cheap click deal deals discount free giveaway offer prize"
    " promo coupon win winner farm spam replica seo backlinks".split()
)


def default_vocabulary(strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> list[tuple[str, float]]:
    return [*((t, 1 / soft_limit) for t in soft), *((t, 1.0) for t in strict)]


def vocabulary(table: DataFrame, most: int = MOST_TERMS) -> list[tuple[str, float]]:
    """The terms and weights of a table (term, weight); one of more than `most` rows is refused."""
    rows = table.filter("term is not null and weight is not null").select("term", F.col("weight").cast("double")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} terms")
    return [tuple(r) for r in rows]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


class Judge:
    def __init__(self, rules=RULES, terms: Iterable[tuple[str, float]] | None = None):
        self.rules: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: -len(r.name)):
            self.rules.setdefault(r.host, []).append(r)
        weights: dict[str, float] = {}
        for term, weight in default_vocabulary() if terms is None else terms:
            if term:
                weights[fold(term)] = max(weight, weights.get(fold(term), 0.0))
        self.words = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.words.add_word(term, (term, weight))
        self.words.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        best, at = None, host
        while at:
            for r in self.rules.get(at, ()):
                if path.startswith(r.path):
                    if best is None or len(r.name) > len(best.name):
                        best = r
                    break
            at = at.partition(".")[2]
        return best

    def terms(self, url: str) -> dict[str, float]:
        """Distinct terms of the vocabulary in the url, with their weights."""
        low, found = fold(url), {}
        if not len(self.words):
            return found
        for end, (term, weight) in self.words.iter(low):
            begin = end + 1 - len(term)
            if not (begin and is_word(low[begin - 1])) and not (end + 1 < len(low) and is_word(low[end + 1])):
                found[term] = weight
        return found

    def __call__(self, url: str | None, host: str, path: str) -> tuple[str | None, str, float]:
        rule, weight = self.rule(host, path), sum(self.terms(url or "").values())
        return rule and rule.name, rule.verdict if rule else "block" if weight > 1 - 1e-9 else "allow", weight


_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(s: str) -> str:
    return s.translate(_FOLD)


def is_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark or hash sign, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash sign."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


MADE = ("host", "path", "rule", "verdict", "term_weight")


def judge_urls(pages: DataFrame, rules=RULES, terms: Iterable[tuple[str, float]] | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and term_weight; columns of these names are replaced."""
    x, names = common.beside(pages, "url", MADE)
    x = x.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    terms = None if terms is None else list(terms)

    def each(batches):
        judge = Judge(rules, terms)
        for batch in batches:
            rows = [judge(*r) for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            made = [pa.array([r[k] for r in rows], pa.float64() if k == 2 else pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["_row", "url", *MADE])

    done = x.mapInArrow(each, common.extended(x.schema, rule="string", verdict="string", term_weight="double"))
    return done.select(*common.rejoined(names, "url"), *MADE)


def filter_urls(pages: DataFrame, **how) -> DataFrame:
    """The pages that are allowed."""
    x = pages.select(common.held(pages, pages.columns).alias("_all"), pages["url"].alias("url"))
    return judge_urls(x, **how).filter(F.col("verdict") == "allow").select(*common.released(pages.columns, "_all"))
