"""Searches over the flat fixture: query and number of rows."""

import pytest
from pyspark.sql import functions as F

from sylva.functions.text import resolve_path
from sylva.operators.leaves import Context
from sylva.operators.search import Filter, SearchSession, command_line, search
from sylva.plans import parser
from sylva.plans.compiler import compile_tree, matches
from sylva.plans.tree import And, Leaf, SearchSyntaxError
from sylva.sources import catalog
from tests.fixtures import FLAT, tree

GOLDEN = {
    "": 13, "folder:": 5, "file:": 8, "!folder:": 8, "root:": 8, "parent:/t/flat": 8, 'parent:""': 8, "parent:\\t\\flat\\": 8, "parent:/T/flat": 0, "parent:/t/flat/a.txt": 0,
    "depth:1": 8, "depth:2": 3, "depth:>1": 4, "depth:0": 1, "ext:conf": 3, "ext:CONF": 3, "ext:*.conf": 3, "ext:conf;txt": 6, "ext:": 0,
    "size:>1k file:": 1, "size:<1k file:": 7, "size:100..1000": 3,
    "size:100-1000": 3, "size:empty file:": 3, "size:!=0 file:": 5, "size:<=500 file:": 7, "size:<tiny file:": 3, "dm:>2000-01-01": 13,
    "dm:<2000-01-01": 0, "dc:>2000-01-01": 13, "empty:": 4,
    "attrib:h": 1, "attrib:!h": 12, "attrib:d": 5, "attrib:z": 0, "child-count:0": 9, "len:4": 3, "ext:conf | ext:log": 4, "ext:conf !file:": 0,
    "!folder: ext:txt": 3, "<ext:conf ext:log>": 0,
    "ext:conf | <ext:log ext:txt>": 3, "ext:<conf log>": 0, "ext:<conf | log>": 4, "ext:<conf;log>": 4, "!!folder:": 5, "conf": 3, "CONF": 3,
    "name:x.conf": 1, "path:sub1": 4, "whole:b.conf": 1, "whole:CONF": 0,
    "startwith:sub": 2, "prefix:sub": 0, "endwith:onf": 3, "suffix:onf": 0, "*.conf": 3, "?.conf": 3, "*conf*": 3, "*on*": 3, "name:*on*": 3,
    "on*": 0, "name:sub1": 1, "sub1": 1, "regex:sub1": 1, "*sub1*": 1,
    "sub1/x.conf": 1, "sub1\\*.conf": 1, "sub1/*": 2, "sub1\\\\*": 2, "ub1/*": 0, "ub1/x.conf": 1, "sub1\\x.conf": 1, "sub1\\\\x.conf": 1,
    "sub1///x.conf": 1, "sub1\\deep/leaf.txt": 1, "path:*x.conf": 1, "path:*sub1*": 4,
    "path:*sub1/x.conf": 1, "path:*conf": 3, "folder: sub1/*": 1, "regex:^b.*conf$": 1, "path:regex:sub1/deep$": 1, "path:regex:[a-z]\\.conf$": 3,
    "case:regex:^B": 0, "nocase:regex:^B": 1, "ww:conf": 3, "child:b.conf": 1,
    "child:<ext:conf>": 2, "!child:b.conf": 12, "child:x.conf | ext:log": 2, "onf": 3, "on": 3, "case:conf": 3, "case:CONF": 0, "ignorepunc:conf": 3,
    "ignorews:conf": 3, "stem:conf": 0, "stem:leaf": 1, "*nf*": 3, "name:onf": 3,
    "diacritics:conf": 3, "path:regex:sub1\\\\x": 1, "type:document": 3, "type:picture": 0, "type:nosuchtype": 0, "type:conf;log": 4,
    "content:xyz": 0, "si:xyz": 0, "dupe:": 0, "image:": 0, "doc:": 3, "folder:sub": 2, "folder:sub1": 1,
    "folder:x.conf": 0, "file:.conf": 3, "startwith:folder:sub1": 1, "startwith:folder:ub1": 0, "case:folder:SUB1": 0, "nosuch:thing": 0,
    "&excl;x": 0, "a&vert;b": 0, "regex:(": 0, "regex:a{2}": 0, "path:**leaf.txt": 1, "[bc].conf": 2,
    "[!b].conf": 2, "[b": 0, "#.conf": 0, "size:<>1k | <5> file:": 5, "sub*/x.conf": 1, '"b.conf"': 1, "depth:1 size:<1k !folder:": 4, "size:2k..10k": 6,
}
BROKEN = ["<a", "a |", '"unterminated', "ext:conf )", "| a", "!", "()"]


@pytest.fixture(scope="module")
def flat(spark):
    e = catalog.enriched(tree(spark, FLAT)).cache()
    e.count()
    return e


def test_golden_counts(flat):
    """All plain queries in one pass: each is a column, counted by one aggregate."""
    ctx, plain, rest = Context(now=1_700_000_000), {}, {}
    for q, n in GOLDEN.items():
        c = compile_tree(parser.parse(q), ctx)
        (rest if c.flags or c.semi else plain)[q] = (c.predicate, n)
    names = list(plain)
    row = flat.agg(*[F.count_if(plain[q][0]).alias(f"c{i}") for i, q in enumerate(names)]).first()
    wrong = {q: (row[i], plain[q][1]) for i, q in enumerate(names) if row[i] != plain[q][1]}
    for q in rest:
        got = matches(flat, q, ctx).count()
        if got != GOLDEN[q]:
            wrong[q] = (got, GOLDEN[q])
    assert not wrong


@pytest.mark.parametrize("text", BROKEN)
def test_broken_searches(text):
    with pytest.raises(SearchSyntaxError):
        parser.parse(text)


def test_parser_shapes():
    assert parser.parse("a b | c").parts[0] == And((Leaf(value="a"), Leaf(value="b")))
    assert parser.parse("case:folder:abc") == And((Leaf("folder"), Leaf(value="abc", mods=frozenset({"case"}))))
    assert parser.parse("dc:!=2024") == Leaf("dc", "2024", "!=")
    assert parser.parse("default:x") == Leaf("default", "x")


def test_pages_counts_and_sorts(flat):
    r = search(flat, "file:", sort="size_descending", count=3)
    assert [x.size for x in r.page().collect()] == [5000, 500, 200]
    assert r.counts().first() == (8, 0, 8)
    assert search(flat, "file:", offset=100).page().count() == 0
    assert [x.dname for x in search(flat, "ext:conf", sort="name_descending").page().collect()] == ["x.conf", "c.conf", "b.conf"]
    up = [x.id for x in search(flat, "", sort="attributes_ascending").page().collect()]
    down = [x.id for x in search(flat, "", sort="attributes_descending").page().collect()]
    assert up == down[::-1] and len(up) == 13
    pos = {x.id: x.pos for x in search(flat, "", sort="path_ascending").positions().collect()}
    assert [i for i, _ in sorted(pos.items(), key=lambda p: p[1])] == [x.id for x in search(flat, "", sort="path_ascending").page().collect()]
    with pytest.raises(ValueError):
        search(flat, "", sort="nothing")


def test_command_line(flat):
    r = command_line(flat, ["ext:conf", "sort:size:desc", "count:2"])
    assert [x.size for x in r.page().collect()] == [5000, 500]
    assert command_line(flat, ["count:0"]).page().count() == 13


def test_session(flat):
    s = SearchSession(flat)
    s.command("search", "conf")
    s.command("size_column", "1")
    s.command("sort", "size_ascending")
    s.command("count", "2")
    assert [tuple(r) for r in s.query().collect()] == [("200", "FILE", "x.conf"), ("500", "FILE", "b.conf")]
    held = s._cached
    s.command("offset", "2")
    assert [r.name for r in s.query().collect()] == ["c.conf"] and s._cached is held
    s.command("filter_search", "x")
    assert s.result().counts().first().total == 1 and s._cached is not held
    s.command("search", "<broken")
    assert s.result().counts().first().total == 0
    s.command("filter_search", "")
    s.command("search", "CONF")
    s.command("case", "1")
    assert s.result().counts().first().total == 0
    with pytest.raises(ValueError):
        s.command("nothing")
    s.close()


def test_second_filter_is_plain_text(flat):
    assert search(flat, "ext:conf", filter=Filter("x")).counts().first().total == 1
    assert search(flat, "ext:conf", filter=Filter("ext:conf")).counts().first().total == 0
    assert search(flat, "ext:conf", filter=Filter("", frozenset({"regex"}))).counts().first().total == 3


def test_words_and_unicode(spark):
    e = catalog.enriched(tree(spark, [("/w", None), ("/w/sylva_x", 1), ("/w/x_sylva", 1), ("/w/sylvax", 1), ("/w/Ünï.txt", 1), ("/w/日本.txt", 1), ("/w/a b", 1)]))
    n = lambda q: matches(e, q).count()
    assert [n(q) for q in ("ww:sylva", "prefix:sylva", "suffix:sylva", "suffix:x", "ww:x")] == [2, 1, 1, 1, 2]
    assert [n(q) for q in ("ü", "Ü", "日本", "diacritics:uni", "ignorews:ab", "a&sp;b")] == [0, 1, 1, 1, 1, 1]


def test_resolve_path():
    assert [resolve_path("/a/b", p) for p in ("c", "../c", "/x//y/", ".", "..\\..\\..", "c\\d/./e", "")] == ["/a/b/c", "/a/c", "/x/y", "/a/b", "/", "/a/b/c/d/e", "/a/b"]


def test_patterns_that_backtrack(spark):
    """A pattern that a backtracking matcher would not end with is answered at once, the same as by the other matcher."""
    import time

    from sylva.functions.text import backtracks

    names = ["a" * 60 + "!", "a" * 60, "A" * 7, "abab", "abac", "x" * 200 + "y", "日本" * 30]
    e = catalog.enriched(tree(spark, [("/w", None)] + [(f"/w/{n}", 1) for n in names])).persist()
    began = time.perf_counter()
    found = lambda q: sorted(r.dname for r in matches(e, q).collect())
    assert found('regex:"^(a+)+$"') == sorted(["a" * 60, "A" * 7]) and found('regex:"^(ab|a)*$"') == sorted(["a" * 60, "A" * 7, "abab"])
    assert found('regex:"x*x*x*x*x*x*z$"') == [] and found('regex:"(本|日)+日本$"') == ["日本" * 30]
    assert time.perf_counter() - began < 30
    plans = {"^b.*conf$": False, "(a+)+$": True, "(a|b)*": True, "(ab)*c": False, "(?:a(b+))*": True, "[(+*]+x": False, "\\(a+\\)+": False, ".*a.*b.*": True}
    assert {p: backtracks(p) for p in plans} == plans


def test_abandoned_query_answers_empty(flat, spark):
    import threading
    import time

    s = SearchSession(flat)
    assert len(s.rows()) == 13
    slow = flat.filter(F.udf(lambda i: time.sleep(5) or True, "boolean")("id"))
    s.refreshed(slow)
    got = {}
    t = threading.Thread(target=lambda: got.update(rows=s.rows()))
    began = time.perf_counter()
    t.start()
    time.sleep(1.5)
    s.abandon()
    t.join(60)
    assert got["rows"] == [] and time.perf_counter() - began < 60
    s.refreshed(flat)
    assert len(s.rows()) == 13
    s.close()


def test_answers_and_reports(flat):
    counts, page = search(flat, "file:", sort="size_descending", count=2).answer("size")
    assert tuple(counts) == (8, 0, 8) and [r.size for r in page] == [5000, 500]
    report = search(flat, "ext:conf", count=2).report()
    assert report["rows"] == 2 and "TakeOrdered" in report["plan"] and report["run_seconds"] > 0


def test_options(monkeypatch, caplog):
    from sylva.plans import options

    assert options.skipped("trigram, cache").names == {"trigram", "cache"} and options.skipped("all").names == set(options.INDEXES)
    monkeypatch.setenv(options.VARIABLE, "cache")
    assert (options.skipped().source, options.skipped().uses("cache"), options.skipped(sidecar="none").names) == ("environment", False, frozenset())
    assert options.skipped("nosuch").names == frozenset() and "nosuch" in caplog.text


def test_trigrams(flat, spark, tmp_path):
    from sylva.operators import trigrams

    trigrams.store(flat, str(tmp_path / "t"))
    index = spark.read.parquet(str(tmp_path / "t"))
    for text in ("conf", "CONF", "on", "x.conf", "leaf.txt", "nothing", "", "conff"):
        assert sorted(r.id for r in trigrams.containing(flat, index, text).collect()) == sorted(r.id for r in matches(flat, f'"{text}"' if text else "").collect()), text
