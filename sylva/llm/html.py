"""Main text of web pages with a site style tree for each host.

Pages are parsed once. All pages of a host are laid over each other: an element is known by its path of tags and
class names, the tree's node. A node's presentation is the sequence of its children, its content the texts that
stand in it. Over a host's pages both have entropies: content that is the same everywhere is boilerplate, content
that always differs is not. A node's composite importance joins the entropy of its presentation with that of its
content and the importance of its children, weighted by GAMMA ** children. It is mixed with a prior, which is high
in a part that is marked as the article and low where a class name says menu, advert and the like; the prior weighs
the less the more pages of the host show the node, so hosts of any size are judged by one rule. A node is noisy, in
articles too, if it and all nodes below it are of importance under LEAST_IMPORTANCE; its texts are removed.

What the markup itself says is no matter of importance: scripts, forms, menus, headers outside of an article,
footers, asides, hidden elements, comments and adverts go, as goes what stands outside of the article where a page
marks one, and blocks that are mostly links where it marks none. Class names count as whole names only (NAMED), and within
an article only with the tree's consent, but for adverts and reader comments.

Statistics are counted by (host, node, digest) with partial sums, and importance is summed up along paths as a join
of nodes: no task gathers a host. Copies count once: pages of a host with the same texts left by the markup's rules.
Each copy gets its row.

Null and empty html: empty text. Null urls share the empty host. Repeated pages get equal results. Empty
table: empty result. Very long pages are parsed whole. Elements nested deeper than MAX_DEPTH are in the tree a part
of the element at that depth; their text is treated like its text.
"""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .urls import host_of

GAMMA = 0.9
LEAST_IMPORTANCE = 0.25
#: Pages of a host that weigh as much as the prior, and what the prior weighs beside any number of pages.
PRIOR_PAGES, PRIOR_LEAST = 3.0, 0.2
#: Priors: in an article without and with a class name; elsewhere; names of noise: of which a part or, in an article, the whole is a structural name; a whole name in an article.
PLAIN_PRIOR, CLASSED_PRIOR, PRIOR, PARTLY_NAMED, NAMED_PRIOR = 1.0, 0.6, 0.5, 0.1, 0.0
STRUCTURAL_PRIOR = 0.3
MAX_DEPTH = 64
MAX_LINK_SHARE = 0.6
#: Bytes of noisy nodes up to which they are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
#: HTML's elements by what they mean for blocks of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul caption".split(
    ))
NOISE = frozenset("head nav footer aside form button select menu dialog svg canvas object audio video map datalist fieldset".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Class names of noise. Adverts and comments go wherever they stand.
ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsored sponsor commercial comment comments commentlist comment-list"
    " comments-area comments-section reader-comments user-comments disqus disqus_thread respond replies sr-only visually-hidden".split()
)
STRUCTURAL = frozenset("banner foot footer form head header masthead notice notices rail search side skip toolbar widget widgets".split())
NAMED = STRUCTURAL | frozenset(
    "ad-banner ad-container adbox alert breadcrumb breadcrumbs consent cookie cookie-banner cookie-bar cookie-consent cookie-notice cookies copyright disclaimer gdpr hidden login"
    " main-menu main-nav menu modal nav navbar navigation newsletter newsletter-signup notification overlay pager pagination popup promo promotion recommended recommendations"
    " related related-articles related-posts share share-buttons sharing sidebar signup site-footer site-header site-nav social social-links social-share subscribe topbar".split()
)
PARTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|menu|nav|navbar|newsletter|share|sidebar|social|sponsor\w*)(?:$|[\s_-])")
NOISE_ROLE = re.compile(r"navigation|banner|contentinfo|complementary|search|dialog|alert|menu|form")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DIGITS = re.compile(r"\d+")


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Element:
    __slots__ = ("block", "children", "depth", "inside", "link", "noise", "path", "prior", "tag", "texts")

    def __init__(self, tag, path, depth, noise, inside, prior, block, link):
        self.tag, self.path, self.depth, self.noise, self.inside, self.prior, self.block, self.link = tag, path, depth, noise, inside, prior, block, link
        self.children, self.texts = [], []


class Page:
    """blocks: (text, path, noise, inside an article or main part, share of text in links);
    nodes: path -> [children, texts, prior] for each block element that holds others or text.

    judged: without it neither marks nor names are heeded, only what is no text at all (scripts, hidden elements).
    """

    def __init__(self, source: str, judged: bool = True):
        self.judged = judged
        self.blocks: list[tuple] = []
        self.nodes: dict[str, list] = {}
        self.stack = [Element("", "", 0, False, False, PRIOR, True, False)]
        self.text: list[str] = []
        self.linked = 0
        at, low = 0, None
        while at < len(source):
            m = TOKEN.search(source, at)
            if not m:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
            elif tag in RAW:
                low = low or source.lower()
                end = low.find(f"</{tag}", at) if len(low) == len(source) else source.find(f"</{tag}", at)
                close = source.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(source)
                if tag not in ("script", "style", "title", "template", "noscript"):
                    self._flush()
            elif tag in VOID:
                if tag == "br":
                    self.text.append(" ")
                elif tag == "hr":
                    self._flush()
            else:
                self._begin(tag, m[3] or m[6] or "")
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _add(self, raw: str) -> None:
        top = self.stack[-1]
        if top.noise and not top.block:  # an inline element of noise within a block
            return
        self.text.append(raw)
        if top.link:
            self.linked += len(raw.strip())

    def _flush(self) -> None:
        if self.text:
            text = " ".join(entities.unescape("".join(self.text)).split())
            if text:
                e = next(x for x in reversed(self.stack) if x.block)
                self.blocks.append((text, e.path, e.noise, e.inside, min(1.0, self.linked / len(text))))
                e.children.append("#")
                e.texts.append(text)
            self.text, self.linked = [], 0

    def _pop(self) -> None:
        e = self.stack.pop()
        if e.block and e.children:
            node = self.nodes.setdefault(e.path, [[], [], e.prior])
            node[0] += [c for k, c in enumerate(e.children) if not k or c != e.children[k - 1]]
            node[1] += e.texts
            node[2] = max(node[2], e.prior)

    def _close(self, tags: tuple, stops: tuple) -> None:
        """Closes the innermost open element of tags unless one of stops stands over it."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self._flush()
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k].tag in stops:
                return

    def _begin(self, tag: str, rest: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
            self._close(("p",), tuple(BLOCK - {"p"}))
            if tag in CLOSES:
                names, stops = CLOSES[tag]
                self._close(tuple(names.split()), stops)
        up = self.stack[-1]
        names = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest.strip() else {}
        label = DIGITS.sub("0", " ".join(filter(None, (names.get("class"), names.get("id")))))
        own = set(label.lower().split()) if tag not in ("html", "body") else set()
        gone = "hidden" in names or names.get("aria-hidden") == "true" or bool(HIDDEN_STYLE.search(names.get("style", "")))
        main, prior = False, PRIOR
        if self.judged:
            main = (tag in ("article", "main") or names.get("role") in ("main", "article")) and not own & ALWAYS
            gone = gone or tag in NOISE or (tag == "header" and not up.inside) or bool(NOISE_ROLE.search(names.get("role", ""))) or bool(own & ALWAYS)
            if not main:
                gone = gone or (not up.inside and bool(own & NAMED))
                if own & NAMED:
                    prior = STRUCTURAL_PRIOR if own & STRUCTURAL else NAMED_PRIOR
                elif own and PARTS.search(label.lower()):
                    prior = CLASSED_PRIOR if up.inside else PARTLY_NAMED
                elif up.inside:
                    prior = CLASSED_PRIOR if label else PLAIN_PRIOR
                if block:
                    prior = min(prior, up.prior)
            else:
                prior = PLAIN_PRIOR
        else:
            gone = gone or tag in ("head", "select", "svg", "canvas", "object", "audio", "video", "map", "datalist")
        noise, inside = up.noise or gone, up.inside or (main and not up.noise and not gone)
        key = tag + (f".{label}" if label else "")
        key = key.replace("/", "|")
        path = f"{up.path}/{key}" if block and up.depth < MAX_DEPTH else up.path
        if path != up.path:
            next(x for x in reversed(self.stack) if x.block).children.append(key)
        self.stack.append(Element(tag, path, up.depth + block, noise, inside, prior if block else up.prior, block, up.link or tag == "a"))

    def _end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                if any(x.block for x in self.stack[k:]):
                    self._flush()
                while len(self.stack) > k:
                    self._pop()
                return
            if tag not in BLOCK and self.stack[k].block:
                return

    def kept(self) -> list[tuple[str, str]]:
        """Text and path of the blocks that the markup's own rules leave."""
        marked = self.judged and any(b[3] and not b[2] for b in self.blocks)
        return [(b[0], b[1]) for b in self.blocks if not (b[2] or (marked and not b[3]) or (self.judged and not marked and b[4] > MAX_LINK_SHARE))]


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BLOCK = T.StructType().add("text", "string").add("path", "string")
_NODE = T.StructType().add("path", "string").add("content", "long").add("style", "long").add("prior", "double")
PARSED = T.StructType().add("digest", "long").add("blocks", T.ArrayType(_BLOCK)).add("nodes", T.ArrayType(_NODE))


def parsed(pages: DataFrame, names: list[str], judged: bool = True) -> DataFrame:
    """_row (the columns of names), host, digest of what the page's rules leave, its blocks and its nodes."""

    def each(batches):
        kind = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string())])), pa.list_(pa.struct([("path", pa.string()),
            ("content", pa.int64()), ("style", pa.int64()), ("prior", pa.float64())]))
        for batch in common.slices(batches, "_html", 8 << 20):
            digests, blocks, nodes = [], [], []
            for source in batch.column(2).to_pylist():
                page = Page(source or "", judged)
                kept = page.kept()
                digests.append(_hash(*(x for b in kept for x in b)))
                blocks.append(kept)
                nodes.append([(path, _hash(*texts) if texts else None, _hash(*children), prior) for path, (children, texts, prior) in page.nodes.items() if path])
            made = [pa.array(digests, pa.int64()), pa.array(blocks, kind[0]), pa.array(nodes, kind[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["_row", "host", "digest", "blocks", "nodes"])

    x = pages.select(common.held(pages, names), host_of(pages["url"]).alias("host"), pages["html"].alias("_html"))
    schema = x.select("_row", "host").schema
    return x.mapInArrow(each, T.StructType([*schema.fields, *PARSED.fields]))


def node_entropies(pages: DataFrame) -> DataFrame:
    """host, path, pages, texts, content, style, prior: entropies over a host's pages, scaled by that of all-different."""
    once = pages.groupBy("host", "digest").agg(F.first("nodes").alias("nodes"))
    each = once.select("host", F.explode("nodes").alias("x")).select("host", "x.*")
    kinds = F.explode(F.array(F.struct(F.lit("content").alias("kind"), F.col("content").alias("d")), F.struct(F.lit("style").alias("kind"), F.col("style").alias("d"))))
    each = each.select("host", "path", "prior", kinds.alias("k")).select("host", "path", "prior", "k.*").filter("d is not null")
    each = each.groupBy("host", "path", "kind", "d").agg(F.count("*").alias("n"), F.max("prior").alias("prior"))
    total = F.sum("n")
    entropy = F.when(total <= 1, F.lit(1.0)).otherwise((F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.log(total))
    node = each.groupBy("host", "path", "kind").agg(total.alias("n"), entropy.alias("h"), F.max("prior").alias("prior"))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return node.groupBy("host", "path").agg(
        pick("style", "n").alias("pages"), F.coalesce(pick("content", "n"), F.lit(0)).alias("texts"), pick("content", "h").alias("content"),
        pick("style", "h").alias("style"), F.max("prior").alias("prior")
    )


def importances(nodes: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """nodes with composite, the importance of each with all that is below it, without the prior.

    composite = own + sum over children of factor * composite, so a node adds its own part, times the factors
    between, to each node over it.
    """
    segments = F.split("path", "/")
    up = F.regexp_replace("path", "/[^/]*$", "")
    below = nodes.groupBy(F.col("host").alias("_h"), up.alias("_p")).agg(F.count("*").alias("kids"), F.sum("pages").alias("kid_pages"))
    x = nodes.join(below, (nodes["host"] == below["_h"]) & (nodes["path"] == below["_p"]), "left").drop("_h", "_p")
    x = x.withColumn("kids", F.coalesce("kids", F.lit(0))).withColumn("weight", F.coalesce("kid_pages", F.lit(0)) + F.col("texts"))
    share = F.pow(F.lit(gamma), F.greatest(F.lit(1), F.col("kids") + (F.col("texts") > 0).cast("int")))
    x = x.withColumn("share", share)
    content = F.col("texts") * F.coalesce("content", F.lit(0.0)) / F.greatest(F.col("weight"), F.lit(1))
    x = x.withColumn("own", F.when(F.col("kids") == 0, F.coalesce("content", F.lit(1.0))).otherwise((1 - F.col("share")) * F.col("style") + F.col("share") * content))
    x = common.written(x.select("host", "path", "pages", "prior", "own", (F.col("share") / F.greatest(F.col("weight"), F.lit(1))).alias("part")), "style-nodes")
    over = F.transform(F.sequence(F.lit(2), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    pairs = x.select("host", "path", F.posexplode(over).alias("j", "over"))
    step = x.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.struct("pages", "part").alias("s"))
    chain = pairs.join(step, (pairs["host"] == step["_h"]) & (pairs["over"] == step["_p"])).groupBy("host",
        "path").agg(F.array_sort(F.collect_list(F.struct("j", "over", "s"))).alias("chain"))
    # products of the factors from a node up to each node over it, itself first
    steps = lambda c: F.transform(F.sequence(F.size(c) - 1, F.lit(0), F.lit(-1)),
        lambda i: F.struct(i.alias("i"), F.when(i < F.size(c) - 1,
        c[i]["s"]["part"] * c[i + 1]["s"]["pages"]).otherwise(F.lit(1.0)).alias("f")))
    put = lambda acc, s: F.concat(acc, F.array(s["f"] * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(1.0))))
    gone = chain.select("host", "path", "chain", F.aggregate(steps(F.col("chain")), F.array().cast("array<double>"), put).alias("products"))
    gone = gone.withColumn("to", F.zip_with(F.reverse("chain"), "products", lambda c, p: F.struct(c["over"].alias("over"), p.alias("product"))))
    own = x.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "own")
    given = gone.join(own, (gone["host"] == own["_h"]) & (gone["path"] == own["_p"])).select("host", "own", F.explode("to").alias("t"))
    total = given.groupBy("host", F.col("t.over").alias("path")).agg(F.sum(F.col("own") * F.col("t.product")).alias("composite"))
    total = total.toDF("_h", "_p", "composite")
    return x.join(total, (x["host"] == total["_h"]) & (x["path"] == total["_p"])).select("host", "path", "pages", "prior", "composite")


def noisy_nodes(nodes: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """host, path of the nodes that are, with all below them, of importance under least."""
    weight = (PRIOR_PAGES + PRIOR_LEAST * F.col("pages")) / (PRIOR_PAGES + F.col("pages"))
    x = nodes.withColumn("importance", weight * F.col("prior") + (1 - weight) * F.col("composite"))
    segments = F.split("path", "/")
    over = F.transform(F.sequence(F.lit(2), F.size(segments)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    return x.select("host", F.explode(over).alias("path"), "importance").groupBy("host",
        "path").agg(F.max("importance").alias("most")).filter(F.col("most") < least).select("host", "path")


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, judged: bool = True) -> DataFrame:
    """pages with text and n_chars in place of html; columns of these names are replaced.

    least: 0 switches the tree off. judged: without it the tree alone decides, with no heed to marks and names.
    """
    names = common.others(pages.columns, ("html", "text", "n_chars"))
    x = common.written(parsed(pages, names, judged), "parsed-pages")
    noisy = common.written(noisy_nodes(importances(node_entropies(x)), least), "noisy-nodes")
    size = noisy.agg(F.sum(F.length("host") + F.length("path") + 16)).first()[0] or 0
    trees = noisy.groupBy(F.col("host").alias("_host")).agg(F.collect_list("path").alias("paths"))
    done = x.join(F.broadcast(trees) if size <= BROADCAST_BYTES else trees, x["host"] == F.col("_host"), "left")
    left = F.filter("blocks", lambda b: ~F.array_contains(F.coalesce("paths", F.array().cast("array<string>")), b["path"]))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n")
    return done.select("_row", text.alias("text")).select(*common.released(names), "text", F.length("text").cast("long").alias("n_chars"))
