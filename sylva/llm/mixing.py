"""Mixing sources to target weights with Efraimidis-Spirakis keys.

Each source has a token budget (target). A source whose budget is e whole epochs and a remainder gives
every document e times; the remainder is filled in the order of exponential keys -ln(u) / weight, prefix
sums cut at the remainder, the document at the cut giving as many words as are still wanted. No source is
sorted as a whole: keys are counted in fine cells per source, the cell in which the cut falls is found from
the cells' prefix sums, and only the rows of that one cell are sorted.

Texts are read once: rows are written with their size, key and cell, all else works on these numbers, and the plan
of a row per source goes to the rows by broadcast if its size allows. Rows never move by source.

The weight is a document's quality: it falls with the share of symbols and with repetition (few distinct words for
so many words), down to WEAKEST. Another weight, a column of docs such as a classifier's score, can be given.

Null text: size 0, taken 0. Null source: a source of its own, last in order. Null doc_id: its key comes from the text
alone. A weight that is null or not over 0 counts as WEAKEST. Equal keys (repeated rows) are ordered by doc_id and
size and are interchangeable after that. Empty table: empty result. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import words

#: Cells of the key's range per source; the cut's cell holds about one part in so many of a source.
CELLS = 1 << 12
#: Rows of the plan, one a source, of under 200 bytes each, up to which it is broadcast.
BROADCAST_SOURCES = 100_000
WEAKEST = 0.05
WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t to \\r."""
    return F.size(words(text)).cast("long")


def quality_weight(text: Column, ws: Column | None = None) -> Column:
    """1 for text that is neither full of symbols nor repetitive, down to WEAKEST ** 2 for what is both. ws: its words."""
    t, ws = F.coalesce(text, F.lit("")), words(text) if ws is None else ws
    marks = F.length(F.regexp_replace(t, "[^#*$%&|<>!]+", "")) / F.greatest(F.length(t), F.lit(1))
    at_least = lambda c: F.greatest(F.lit(WEAKEST), F.least(F.lit(1.0), c))
    variety = F.when(F.size(ws) < 20, F.lit(1.0)).otherwise(F.log(F.size(F.array_distinct(ws)) + 1.0) / F.log(F.size(ws) + 1.0))
    return at_least(1 - 7.5 * marks) * at_least((variety - 0.4) / 0.3)


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the digest of a key and a seed: the same in every run."""
    head = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 12)
    return (F.conv(head, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = EPOCHS) -> DataFrame:
    """source, source_size, target: a row for each source. The sum of all sizes is shared by weight; a source
    stops at `most` times its size and what it leaves is shared anew. Sources are ordered by code point, null
    last. The sources still open after a round are those with the larger size per weight, so the level at
    which water stands is found from prefix sums over size / weight instead of by rounds. One row per source
    is sorted in one task: the table of sources is taken to be small, not the corpus.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ws = F.array(*[F.lit(w) for w in weights])
    x = sizes.withColumn("w", F.element_at(ws, (rank % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    every = Window.orderBy("r", F.col("source").isNull(), "source")
    below = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    x = x.withColumn("left_", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
    x = x.withColumn("wleft", F.sum("w").over(every.rowsBetween(0, Window.unboundedFollowing)))
    # the level is that of the first source, by size per weight, whose own cap lies above it
    first = F.first(F.when(F.col("left_") / F.col("wleft") <= F.col("r"), F.col("left_") / F.col("wleft")),
        True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("level", first)
    return x.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.coalesce("level", F.lit(0.0))).alias("target"))


def mix(
    docs: DataFrame, seed: str = "mix-1", weights: tuple[float, ...] = WEIGHTS, most: int = EPOCHS, cells: int = CELLS,
    columns: tuple[str, ...] | None = None, quality: Column | None = None
) -> DataFrame:
    """docs with size, source_size, target, taken (words the mix takes of the document, repeats counted).

    columns: those of docs to keep (all by default); columns named like the results are replaced.
    quality: the documents' weights, by default that of their texts.
    """
    keep = common.others(columns or docs.columns, ("size", "source_size", "target", "taken"))
    given = F.lit(None).cast("double") if quality is None else F.coalesce(F.when(quality > 0, quality.cast("double")), F.lit(WEAKEST))
    own = F.coalesce(docs["doc_id"].cast("string"), F.md5(F.coalesce(docs["text"], F.lit(""))))
    x = docs.select(common.held(docs, keep), docs["doc_id"].alias("_id"), docs["text"].alias("_t"), words(docs["text"]).alias("_w"),
        own.alias("_own"), given.alias("_given"), docs["source"].alias("_source"))
    weight = quality_weight(F.col("_t"), F.col("_w")) if quality is None else F.col("_given")
    x = x.select("_row", "_id", F.size("_w").cast("long").alias("size"), (-F.log(uniform(F.col("_own"), seed)) / weight).alias("_key"), "_source")
    # 1 - exp(-key) spreads the exponential keys over (0, 1) for the cells
    x = x.withColumn("_cell", F.least(F.lit(cells - 1), F.floor((1 - F.exp(-F.col("_key"))) * cells)).cast("int")).withColumn("_n", F.monotonically_increasing_id())
    x = common.written(x, "mix")
    per_cell = x.groupBy("_source", "_cell").agg(F.sum("size").alias("cell_size"))
    per_source = per_cell.groupBy(F.col("_source").alias("source")).agg(F.sum("cell_size").alias("source_size"))
    goal = targets(per_source, weights, most).withColumnRenamed("source", "_s")
    w = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = per_cell.withColumn("before", F.coalesce(F.sum("cell_size").over(w), F.lit(0)))
    plan = plan.join(goal, plan["_source"].eqNullSafe(goal["_s"]))
    whole = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", epochs).withColumn("room", whole - F.col("epochs") * F.col("source_size") - F.col("before"))
    cut = (F.col("room") > 0) & (F.col("room") < F.col("cell_size"))
    plan = plan.groupBy("_s").agg(  # a row per source: cells up to `full` are taken, `cut` is taken in part
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("epochs"),
        F.coalesce(F.max(F.when(F.col("room") >= F.col("cell_size"), F.col("_cell"))), F.lit(-1)).alias("_full"),
        F.coalesce(F.max(F.when(cut, F.col("_cell"))), F.lit(-1)).alias("_cut"), F.max(F.when(cut, F.col("room"))).alias("_room"),
    )
    plan = common.written(plan, "mix-plan")
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    planned = lambda df: df.join(plan, df["_source"].eqNullSafe(plan["_s"]))
    base = F.col("epochs") * F.col("size")
    out = lambda df, taken: df.select(*common.released(keep), F.col("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target"),
        taken.cast("long").alias("taken"))
    at_cut = F.col("_cell") == F.col("_cut")
    plain = out(planned(x).filter(~at_cut), base + F.when(F.col("_cell") <= F.col("_full"), F.col("size")).otherwise(F.lit(0)))
    # the cut's cells are ordered by numbers alone, their rows are fetched by number
    order = Window.partitionBy("_source").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = planned(x.select("_n", "_source", "_key", "_id", "size", "_cell")).filter(at_cut)
    edge = edge.select(F.col("_n").alias("_m"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("_before"))
    cuts = planned(x).filter(at_cut)
    edge = out(cuts.join(edge, cuts["_n"] == edge["_m"]), base + F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room") - F.col("_before"))))
    return plain.unionByName(edge)
