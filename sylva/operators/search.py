"""Searches with filter, order and page, and the session that remembers a client's options."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.compiler import matches
from ..plans.tree import Leaf, SearchSyntaxError
from . import ordering, output
from .leaves import Context, text_match


@dataclass(frozen=True)
class Filter:
    """A second text predicate beside the search: a plain term with its own flags, not read as a search."""

    text: str = ""
    flags: frozenset[str] = frozenset()

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        if not self.text:
            return df
        plain = replace(ctx, options=frozenset())
        return df.filter(F.coalesce(text_match(Leaf("", self.text, mods=self.flags), plain), F.lit(False)))


@dataclass
class Result:
    matched: DataFrame
    sort: str = "name_ascending"
    offset: int = 0
    count: int | None = None

    def counts(self) -> DataFrame:
        """total, folders, files: independent of the page."""
        return self.matched.agg(F.count("*").alias("total"), F.count_if("is_dir").alias("folders"), F.count_if(~F.col("is_dir")).alias("files"))

    def page(self) -> DataFrame:
        columns, ascending = ordering.sort_key(self.sort)
        return ordering.page(self.matched, columns, ascending, self.offset, self.count)

    def positions(self) -> DataFrame:
        columns, ascending = ordering.sort_key(self.sort)
        return ordering.positions(self.matched, columns, ascending)

    def answer(self, *columns: str) -> tuple[Row, list[Row]]:
        """The counts and the page's rows, by two jobs side by side."""
        with ThreadPoolExecutor(1) as pool:
            counts = pool.submit(lambda: self.counts().first())
            page = self.page()
            return counts.result(), (page.select(*columns) if columns else page).collect()

    def report(self) -> dict[str, object]:
        """How the page is made and how long it took: the plan, whether filters reach a scan, seconds for each step."""
        began = time.perf_counter()
        page = self.page()
        plan = page._jdf.queryExecution().executedPlan().toString()
        planned = time.perf_counter()
        rows = len(page.collect())
        return {"plan": plan, "pushed": "PushedFilters: [" in plan and "PushedFilters: []" not in plan, "rows": rows, "plan_seconds": planned - began,
            "run_seconds": time.perf_counter() - planned}


def search(entries: DataFrame, text: str, sort: str = "name_ascending", offset: int = 0, count: int | None = None, filter: Filter = Filter(), ctx: Context | None = None) -> Result:
    """A search over enriched entries. A search that cannot be read raises SearchSyntaxError."""
    ctx = ctx or Context()
    ordering.sort_key(sort)
    return Result(filter.apply(matches(entries, text, ctx), ctx), sort, offset, count)


def command_line(entries: DataFrame, terms: list[str], ctx: Context | None = None) -> Result:
    """Terms with sort:key[:asc|desc], count:n (0: all) and offset:n among them."""
    sort, offset, count, rest = "name_ascending", 0, None, []
    short = {"ext": "extension", "mtime": "date_modified", "dm": "date_modified", "ctime": "date_created", "dc": "date_created"}
    for t in terms:
        head, _, value = t.partition(":")
        if head == "sort" and value:
            key, _, way = value.partition(":")
            sort = f"{short.get(key, key)}_{'descending' if way.startswith('desc') else 'ascending'}"
        elif head == "count" and value.isdigit():
            count = int(value) or None
        elif head == "offset" and value.isdigit():
            offset = int(value)
        else:
            rest.append(t)
    return search(entries, " ".join(rest), sort, offset, count, ctx=ctx)


MATCH_OPTIONS = {"case": "case", "whole_word": "ww", "path": "path", "diacritics": "diacritics", "prefix": "prefix", "suffix": "suffix",
    "ignore_punctuation": "ignorepunc", "ignore_whitespace": "ignorews", "regex": "regex"}


@dataclass
class SearchSession:
    """A client's options. The matched rows of the last query stay cached, so that paging only sorts and slices.

    epoch: changes whenever the catalog could answer differently; it is part of the cache's key.
    """

    entries: DataFrame
    ctx: Context = field(default_factory=Context)
    epoch: int = 0
    text: str = ""
    options: frozenset[str] = frozenset()
    filter: Filter = Filter()
    sort: str = "name_ascending"
    offset: int = 0
    count: int | None = None
    columns: frozenset[str] = frozenset()
    hide_empty: bool = False
    tag: str = field(default_factory=lambda: f"session-{uuid.uuid4().hex}")
    _abandoned: bool = False
    _key: tuple | None = None
    _cached: DataFrame | None = None

    def command(self, name: str, value: str = "") -> DataFrame | None:
        """One of the session's 32 commands; only query answers with rows."""
        name = name.lower()
        on = value.strip() not in ("", "0", "off", "false")
        if name == "search":
            self.text = value
        elif name in MATCH_OPTIONS:
            self.options = self.options | {MATCH_OPTIONS[name]} if on else self.options - {MATCH_OPTIONS[name]}
        elif name == "hide_empty_search_results":
            self.hide_empty = on
        elif name == "filter_search":
            self.filter = replace(self.filter, text=value)
        elif name.removeprefix("filter_") in MATCH_OPTIONS and name.startswith("filter_"):
            flag = MATCH_OPTIONS[name.removeprefix("filter_")]
            self.filter = replace(self.filter, flags=self.filter.flags | {flag} if on else self.filter.flags - {flag})
        elif name == "sort":
            ordering.sort_key(value)
            self.sort = value.lower()
        elif name == "offset":
            self.offset = int(value)
        elif name == "count":
            self.count = int(value)
        elif name.removesuffix("_column") in output.COLUMNS and name.endswith("_column"):
            column = name.removesuffix("_column")
            self.columns = self.columns | {column} if on else self.columns - {column}
        elif name == "query":
            return self.query()
        else:
            raise ValueError(f"no such command: {name}")
        return None

    def result(self) -> Result:
        """The current result; a search that cannot be read has no rows."""
        key = (self.epoch, self.text, self.options, self.filter, self.hide_empty)
        if key != self._key:
            self.close()
            try:
                matched = search(self.entries, self.text, filter=self.filter, ctx=replace(self.ctx, options=self.options)).matched
            except SearchSyntaxError:
                matched = self.entries.limit(0)
            self._key, self._cached = key, matched.persist()
        return Result(self._cached, self.sort, self.offset, self.count)

    def query(self) -> DataFrame:
        return output.project(self.result().page(), tuple(self.columns))

    def rows(self) -> list[Row]:
        """The current page's rows; none if abandon() was called meanwhile, and then the cached rows stay as they were."""
        context = self.entries.sparkSession.sparkContext
        self._abandoned = False
        context.addJobTag(self.tag)
        try:
            return self.query().collect()
        except Exception:
            if self._abandoned:
                return []
            raise
        finally:
            context.removeJobTag(self.tag)

    def abandon(self) -> None:
        """Another command supersedes the query that runs: it ends and answers empty. Called from another thread."""
        self._abandoned = True
        self.entries.sparkSession.sparkContext.cancelJobsWithTag(self.tag)

    def refreshed(self, entries: DataFrame) -> None:
        """The catalog has changed."""
        self.entries, self.epoch = entries, self.epoch + 1

    def close(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
        self._key = self._cached = None
