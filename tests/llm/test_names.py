"""Columns whose names clash with those that operators make, in another case, or that need quoting, at every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sylva.llm import decontaminate, html, mixing, neardup, pii, quality, secrets, suffix, tokens, urls
from tests.llm.data import prose

CLASHES = ["N_TOKENS", "Over_Limit", "HOST", "Path", "RULE", "VERDICT", "Term_Weight", "KEPT", "BASE_FAILED", "N_Words", "TAKEN", "SIZE", "Target",
    "FINDINGS", "N_PII", "N_Card", "_HITS", "_Items", "_N_hit", "N_CHARS", "Component_Id", "_row", "_key", "_w", "_t", "_n"]
ODD = ["a.b", "a b", "back`tick", "_ROW2", "select", "ünï", "1st"]


def wide(spark, texts=True):
    """Documents or pages with clashing and odd columns, one of them a struct whose field's name has a blank."""
    key, body = ("doc_id", "text") if texts else ("page_id", "html")
    rows = [(k, prose(k, 60 + k) if k % 5 else None) for k in range(20)] + [(3, prose(3, 63))]
    df = spark.createDataFrame(rows, f"{key} long, {body} string").withColumns({"lang": F.lit("en"), "source": F.lit("s"),
        "url": F.concat(F.lit("http://x.net/"), F.col(key).cast("string"))})
    return df.select("*", *[F.lit(f"v {c}").alias(c) for c in [*CLASHES, *ODD]], F.struct(F.col(key).alias("a b"), F.lit("x").alias("c`d")).alias("nested"))


def bench(spark):
    return spark.createDataFrame([(1, prose(4, 20))], "item_id long, text string")


OPERATORS = {
    "scan": lambda s, d: decontaminate.scan(d, bench(s)), "remove_documents": lambda s, d: decontaminate.remove_documents(d, bench(s)),
    "remove_spans": lambda s, d: decontaminate.remove_spans(d, bench(s)), "judge_urls": lambda s, d: urls.judge_urls(d), "filter_urls": lambda s,
    d: urls.filter_urls(d),
    "pseudonymise": lambda s, d: pii.pseudonymise(d, "k"), "secret_scan": lambda s, d: secrets.scan(d, labelled=secrets.labelled_findings(s, 300)),
    "redact": lambda s, d: secrets.redact(d, labelled=secrets.labelled_findings(s, 300)),
    "token_counts": lambda s, d: tokens.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")), "judge": lambda s, d: quality.judge(d),
    "good": lambda s, d: quality.good(d), "mix": lambda s, d: mixing.mix(d), "keep_one": lambda s, d: neardup.keep_one(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_stay(spark, name):
    docs = wide(spark)
    done = OPERATORS[name](spark, docs)
    rows = done.collect()
    assert rows and len({c.lower() for c in done.columns}) == len(done.columns)
    low = [c.lower() for c in done.columns]
    for c in ODD:
        at = low.index(c.lower())
        assert {r[at] for r in rows} == {f"v {c}"}, c
    assert {r[low.index("nested")]["a b"] == r[low.index("doc_id")] for r in rows} == {True}
    made = {c.lower() for c in done.columns} - {c.lower() for c in docs.columns}
    untouched = [c for c in CLASHES if any(c.lower() in low and r[low.index(c.lower())] == f"v {c}" for r in rows)]
    assert len(untouched) + len(made) > 0 and len(rows) <= docs.count()


def test_pages(spark):
    pages = wide(spark, texts=False)
    done = html.extract(pages)
    assert "html" not in done.columns and done.count() == 21 and {"text", "n_chars"} <= set(done.columns)
    assert all(r["a.b"] == "v a.b" and r["nested"]["a b"] == r.page_id for r in done.collect())


def test_operators_with_their_own_columns(spark):
    docs = wide(spark)
    assert suffix.deduplicate(docs).count() == 21 and neardup.clusters(docs).count() == 21


def test_stages(spark):
    import corpus_pipeline

    docs = wide(spark)
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0), docs.filter("text is null"), docs.withColumn("doc_id", F.lit(None).cast("long"))):
            done = stage(spark, df, "/root/testdata/sf0.001")
            assert name == "source_mix" or done.columns == docs.columns, name
            rows = done.collect()
            assert len(rows) <= df.count() and all(r["a.b"] == "v a.b" for r in rows), name
    done = mixing.mix(docs.filter("text is null"))
    assert done.count() == docs.filter("text is null").count() and done.agg(F.sum("taken")).first()[0] == 0
