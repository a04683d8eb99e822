"""Quality rules: repetition and length rules, then the divergence of a document from its language.

The main path is DataFrame functions only. One pass over the texts computes for each document its counts,
a histogram of character classes and a histogram of common words (in lower case, without punctuation at their
ends); these small rows are written once. A document of enough words is rejected if its Jensen-Shannon distances
to its language's reference are both high or one is very high.

References are a table of a row per language: lang, docs, version, class shares and the share of each common word
among all words. `reference_table` makes it from documents that pass the base rules: the median share of each class
(junk hardly moves it) and the words' shares over all of them. Kept and given to `judge`, it makes a verdict independent of
the documents beside it; without it the references are made from the documents judged. The fewer documents a
reference comes from, the wider its limits: by 1 + SLACK / docs, for every language alike.

Null and empty texts: all counts 0, base_failed, not kept. Null languages are a language of their own. A document
of fewer than MIN_WORDS words, or of a language without a reference, is judged by the base rules alone. Repeated
rows are judged alike. Empty table: empty result. Other columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_WORDS = 50
#: How much wider the limits are for a reference of one document.
SLACK = 2.0
VERSION = 1
#: Rows of the reference table, of a few KB each, up to which it is broadcast; a larger one is joined by shuffle.
MAX_BROADCAST_LANGUAGES = 1000
#: A document is rejected if both distances are over the first two, or either is over its second limit.
BOTH = (0.2, 0.26)
EITHER = (0.3, 0.4)
#: Frequent function words by language.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by this from at or an not but have",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur ne se ce il elle avec plus",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus",
}
ALL_COMMON = sorted({w for ws in COMMON.values() for w in ws.split()})
#: Punctuation that a common word may have at its ends.
ENDS = ".,;:!?\"()[]"
CLASSES = ("upper", "digit", "stop", "mark", "white", "wide", "other")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rest(a: Column, k: int) -> Column:
    """a without its first k elements."""
    return F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(common.WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def window_hashes(ws: Column, width: int = WINDOW) -> Column:
    """A hash of each run of `width` (a power of two) words: pairs, pairs of pairs and so on."""

    def joined(k: int):
        return lambda x: F.zip_with(x, _rest(x, k), lambda p, q: F.xxhash64(p, q))

    a, k = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while k < width:
        a, k = _let(a, joined(k)), 2 * k
    return F.slice(a, 1, F.greatest(F.size(ws) - (width - 1), F.lit(0)))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Number of words within windows that are found more than once."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        ahead = F.zip_with(s, _rest(s, 1), lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("e")))
        behind = F.concat(F.slice(s, 1, 1), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
        hit = lambda a, b: F.when(a["e"] | ((a["h"] == b["h"]) & (a["i"] != b["i"])), a["i"])
        return F.array_sort(F.array_compact(F.zip_with(ahead, behind, hit)))

    covered = lambda p: F.aggregate(F.zip_with(p, _rest(p, 1), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))), F.lit(0), lambda x, y: x + y)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(_let(ordered, positions), covered)).cast("long")


def _n(text: Column, but: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{but}]+", ""))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row per document: the base counts, class counts and counts of common words."""
    t = F.col("_t")
    x = docs.select(common.held(docs, keep), F.coalesce(docs["text"], F.lit("")).alias("_t"), docs["lang"].alias("_lang"))
    x = x.withColumn("_w", words(t))
    x = x.withColumn("_h", window_hashes(F.col("_w")))
    ws, n = F.col("_w"), F.size("_w").cast("long")
    lines = F.filter(F.split(t, "\n"), lambda s: F.btrim(s, F.lit(common.WHITE)) != "")
    seen = F.filter(F.transform(ws, lambda w: F.lower(F.btrim(w, F.lit(ENDS)))), lambda w: w.isin(ALL_COMMON))
    counts = _let(seen, lambda s: F.transform(F.array_distinct(s), lambda w: F.struct(w.alias("w"), F.size(F.filter(s, lambda y: y == w)).alias("n"))))
    x = x.select(
        "_row", "_lang", n.alias("n_words"), F.length(F.translate(t, common.WHITE, "")).cast("long").alias("word_chars"), _n(t, "#*$%&|<>").cast("long").alias("n_symbols"),
        F.when(F.instr(t, "\n") == 0, F.lit(0)).otherwise(_let(lines,
        lambda s: F.size(s) - F.size(F.array_distinct(s)))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_h")).alias("n_repeat_words"),
        F.length(t).cast("long").alias("_chars"), (F.octet_length(t) - F.length(t)).cast("long").alias("wide"),
        _n(t, "A-Z").cast("long").alias("upper"), _n(t, "0-9").cast("long").alias("digit"), _n(t, ".,;:?'\"()-").cast("long").alias("stop"),
        _n(t, "!@\\[\\]{}_=+~^`/\\\\").cast("long").alias("mark"), counts.alias("_common"),
    )
    x = x.withColumn("mark", F.col("mark") + F.col("n_symbols")).withColumn("white", F.col("_chars") - F.col("word_chars"))
    x = x.withColumn("other", F.greatest(F.lit(0), F.col("_chars") - F.col("upper") - F.col("digit") - F.col("stop") - F.col("mark") - F.col("white") - F.col("wide")))
    return x.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _js(pairs: list[tuple[Column, Column]]) -> Column:
    """Jensen-Shannon distance (base 2, square root of the divergence) of two histograms given bin by bin."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    total = reduce(lambda a, b: a + b, [part(p, (p + q) / 2) + part(q, (p + q) / 2) for p, q in pairs])
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def reference_table(docs: DataFrame, version: int = VERSION) -> DataFrame:
    """The references of documents that pass the base rules, to be kept and given to judge()."""
    return references(common.written(features(docs, []), "quality")).withColumn("version", F.lit(version))


def references(seen: DataFrame) -> DataFrame:
    """A row per language: lang, docs, median share of each class, and share of each common word among all words."""
    good = seen.filter(~F.col("base_failed"))
    classes = good.groupBy("_lang").agg(F.count("*").alias("docs"),
        *[F.percentile_approx(F.col(c) / F.greatest("_chars", F.lit(1)), F.lit(0.5), F.lit(10_000)).alias(c) for c in CLASSES])
    n = good.groupBy("_lang").agg(F.sum("n_words").alias("all"))
    each = good.select("_lang", F.explode("_common").alias("c")).groupBy("_lang", F.col("c.w").alias("w")).agg(F.sum("c.n").alias("n"))
    each = each.join(n.withColumnRenamed("_lang", "_l2"),
        F.col("_lang").eqNullSafe(F.col("_l2"))).groupBy("_lang").agg(F.map_from_entries(F.collect_list(F.struct("w",
        (F.col("n") / F.col("all")).alias("q")))).alias("words"))
    each = each.withColumnRenamed("_lang", "_l3")
    return classes.join(each, classes["_lang"].eqNullSafe(each["_l3"]), "left").drop("_l3").withColumnRenamed("_lang", "lang")


def judge(
    docs: DataFrame, columns: list[str] | None = None, both: tuple[float, float] = BOTH, either: tuple[float, float] = EITHER,
    min_words: int = MIN_WORDS, reference: DataFrame | None = None
) -> DataFrame:
    """columns of docs (all but text by default) with the counts, both distances, base_failed and kept.

    reference: a table of reference_table(); without it the references come from docs.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", *CLASSES}
    keep = common.others(columns or docs.columns, made if columns else {*made, "text"})
    seen = common.written(features(docs, keep), "quality")
    ref = common.written(references(seen), "languages") if reference is None else reference
    ref = ref.select(*[F.col(c).alias("_l" if c == "lang" else f"r_{c}") for c in ("lang", "docs", "words", *CLASSES)])
    if ref.count() <= MAX_BROADCAST_LANGUAGES:
        ref = F.broadcast(ref)
    x = seen.join(ref, seen["_lang"].eqNullSafe(ref["_l"]), "left")
    chars = F.greatest(F.col("_chars"), F.lit(1))
    x = x.withColumn("class_distance", _js([(F.col(c) / chars, F.coalesce(F.col(f"r_{c}"), F.lit(0.0))) for c in CLASSES]))
    # bins of words that the document lacks add q / 2 each: their sum follows from the present ones
    q = F.coalesce("r_words", F.create_map().cast("map<string,double>"))
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    bins = F.transform(F.col("_common"), lambda c: F.struct((c["n"] / F.col("n_words")).alias("p"), F.coalesce(F.element_at(q, c["w"]), F.lit(0.0)).alias("q")))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, b: s + f(b))
    x = x.withColumn("_b", bins).withColumn("_qall", total(F.map_values(q), lambda v: v))
    x = x.withColumn("_p", total(F.col("_b"), lambda b: b["p"])).withColumn("_q", total(F.col("_b"), lambda b: b["q"]))
    inside = total(F.col("_b"), lambda b: part(b["p"], (b["p"] + b["q"]) / 2) + part(b["q"], (b["p"] + b["q"]) / 2))
    po, qo = F.greatest(F.lit(0.0), 1 - F.col("_p")), F.greatest(F.lit(0.0), 1 - F.col("_qall"))
    js = (inside + (F.col("_qall") - F.col("_q")) + part(po, (po + qo) / 2) + part(qo, (po + qo) / 2)) / 2
    x = x.withColumn("word_distance", F.sqrt(F.greatest(F.lit(0.0), js)))
    guarded = (F.col("n_words") < min_words) | F.col("r_docs").isNull()
    c, w, wider = F.col("class_distance"), F.col("word_distance"), 1 + F.lit(SLACK) / F.col("r_docs")
    far = ((c > both[0] * wider) & (w > both[1] * wider)) | (c > either[0] * wider) | (w > either[1] * wider)
    kept = ~F.col("base_failed") & (guarded | ~far)
    return x.select(*common.released(keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"),
        "class_distance", "word_distance")


def good(docs: DataFrame, **limits) -> DataFrame:
    """docs without those that are rejected. Rows go through whole, whatever their columns are called."""
    x = docs.select(common.held(docs, docs.columns).alias("_all"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    return judge(x, ["_all"], **limits).filter("kept").select(*common.released(docs.columns, "_all"))
