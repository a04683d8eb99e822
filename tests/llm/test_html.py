"""Main text: what the markup's rules leave, and the style tree against one built by recursion."""

import collections
import math

import pytest

from sylva.llm import html

SCHEMA = "page_id long, url string, html string"

def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>no</title><script>var a = "<p>no</p>";</script></head><body class="x-sidebar"><header>no</header><nav><a href=#>no</a></nav>
    <article><h1>A &amp; B</h1><p>one<br>two <b>three<p>four&nbsp;&lt;5&gt;<ul><li>six<li>seven</ul><div class="share">no</div><div class="comments"><p>no</div></article><aside>no</aside><form>no<input></form><footer>no"""
    plain = "<div><p>First block of text</p><p>Second   block</p></div><div class='cookie-notice'>no</div><!-- no --><p hidden>no</p>"
    rows = [(1, "http://h.net/a", page), (2, None, plain), (3, "http://h.net/b", None), (4, "http://h.net/c", ""), (5, "x", "a < b <c>d"), (5, "x", "a < b <c>d")]
    df = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    want = {1: "A & B\none two three\nfour <5>\nsix\nseven", 2: "First block of text\nSecond block", 3: "", 4: "", 5: "a < b d"}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html.extract(df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = "<body><div class='top'><p>Welcome to our site, dear reader</p></div><div class='story'><p>Story {} is long</p></div></body>"
    rows = [(k, f"http://c.net/{k}", page.format("one")) for k in range(400)] + [(k, f"http://c.net/{k}", page.format(k)) for k in range(400, 430)]
    rows += [(k, f"http://d.net/{k}", page.format("one")) for k in range(500, 520)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == f"Story {'one' if k < 400 else k} is long" for k in range(430))
    assert all(got[k].endswith("Story one is long") for k in range(500, 520))



def test_site_style_tree(spark):
    """What is the same on all pages of a host goes; what differs stays."""
    rows = [(k, f"http://s.net/{k}",
        f"<body><div class='top'><p>Welcome to our site, dear reader</p></div><div class='story'><p>Story number {k} is long</p></div></body>") for k in range(30)]
    rows += [(100, "http://t.net/1", rows[0][2])]
    got = texts(spark, rows)
    assert all(got[k] == f"Story number {k} is long" for k in range(30))
    assert got[100] == "Welcome to our site, dear reader\nStory number 0 is long"


def texts(spark, rows, **how):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, SCHEMA), **how).collect()}


ARTICLE = """<body><nav><a href=/>Home</a></nav><article><div class="article-header"><h1>Title {k}</h1></div><p>First part {k}.</p>
<div class="tellafriend"><p>Tell a friend</p><p>Print this</p></div><section class="side-effects"><p>Nausea {k}</p></section>
<div class="related-work"><p>Other work {k}</p></div><div class="header"><h2>More on {k}</h2></div><p>Last <span class="ad">buy!</span>part.</p><div class="comments"><p>Nice {k}</p></div></article><footer>End</footer></body>"""


def test_the_tree_decides_within_articles(spark):
    """A box without a telling name that all pages show goes, by the tree alone; sections with unlucky names stay."""
    rows = [(k, f"http://a.net/{k}", ARTICLE.format(k=k)) for k in range(40)]
    got, off = texts(spark, rows), texts(spark, rows, least=0.0)
    for k in range(40):
        want = f"Title {k}\nFirst part {k}.\nNausea {k}\nOther work {k}\nMore on {k}\nLast part."
        assert got[k] == want
        assert off[k] == want.replace(f"First part {k}.", f"First part {k}.\nTell a friend\nPrint this")
    # a page that stands alone gives no evidence
    assert "Tell a friend" in texts(spark, rows[:1])[0]
    # without marks and names the tree still tells what all pages share
    alone = texts(spark, rows, judged=False)
    assert all("Home" not in alone[k] and "Tell a friend" not in alone[k] and f"First part {k}." in alone[k] for k in range(40))


def test_articles_under_several_addresses_are_kept(spark):
    """The same article with another script or advert each time is one page to the tree."""
    page = "<body><script>track({k})</script><div class=ad>Buy {k}</div><article><h1>One</h1><div class=entry><p>The same story</p></div></article></body>"
    got = texts(spark, [(k, f"http://a.net/{k}", page.format(k=k)) for k in range(50)])
    assert set(got.values()) == {"One\nThe same story"}


def test_deep_nesting(spark):
    rows = [(k, f"http://d.net/{k}", "<div>" * 3000 + f"deep {k}" + "</div>" * 3000 + "<b>" * 3000 + "<p>" * 300 + "end") for k in range(3)]
    assert texts(spark, rows) == {k: f"deep {k}\nend" for k in range(3)}


def by_recursion(pages, gamma=html.GAMMA):
    """(host, path) -> (importance, pages, prior) by recursion over a tree of dictionaries."""
    hosts = collections.defaultdict(dict)
    for _, url, source in pages:
        page = html.Page(source)
        hosts[url.split("/")[2]].setdefault(tuple(page.kept()), page)
    out = {}
    for host, once in hosts.items():
        seen = collections.defaultdict(list)
        for page in once.values():
            for path, node in page.nodes.items():
                seen[path].append(node)

        def entropy(values):
            n = len(values)
            counts = collections.Counter(values).values()
            return 1.0 if n <= 1 else -sum(c / n * math.log(c / n) for c in counts) / math.log(n)

        def importance(path):
            nodes = seen[path]
            kids = [p for p in seen if p and p.rpartition("/")[0] == path and p != path]
            content = [tuple(n[1]) for n in nodes if n[1]]
            parts = [(len(seen[p]), importance(p)) for p in kids] + ([(len(content), entropy(content))] if content else [])
            inner = sum(w * v for w, v in parts) / sum(w for w, _ in parts) if parts else 1.0
            share = gamma ** max(1, len(parts))
            value = (1 - share) * entropy([tuple(n[0]) for n in nodes]) + share * inner if kids else inner
            if path:
                out[host, path] = (value, len(nodes), max(n[2] for n in nodes))
            return value

        importance("")
    return out


def test_importance_by_recursion(spark):
    rows = [(k, f"http://a.net/{k}", ARTICLE.format(k=k // 2)) for k in range(40)] + [(99, "http://a.net/x", "<div><p>once</p><ul><li>a<li>b</ul></div>")]
    rows += [(100 + k, f"http://b.net/{k}",
        f"<div class='x'><p>{k % 3}</p>" + "<p>same</p>" * (k % 2) + f"<div><p>{k}</p></div></div><div class=menu><p>m</p></div>") for k in range(9)]
    nodes = html.node_entropies(html.parsed(spark.createDataFrame(rows, SCHEMA), ["page_id"]))
    got = {(r.host, r.path): (r.composite, r.pages, r.prior) for r in html.importances(nodes).collect()}
    want = by_recursion(rows)
    assert got.keys() == want.keys() and len(got) > 15
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k
    weight = lambda n: (html.PRIOR_PAGES + html.PRIOR_LEAST * n) / (html.PRIOR_PAGES + n)
    mixed = {k: weight(n) * prior + (1 - weight(n)) * v for k, (v, n, prior) in want.items()}
    noisy = {k for k in mixed if all(v < html.LEAST_IMPORTANCE for (h, p), v in mixed.items() if h == k[0] and (p + "/").startswith(k[1] + "/"))}
    assert noisy == {(r.host, r.path) for r in html.noisy_nodes(html.importances(nodes)).collect()} and noisy
