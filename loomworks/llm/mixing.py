"""Operator 5: mixing sources to target weights.

Plan
1. One map-side combined aggregation gives words per (source, range of the key); a document's key is a hash of its id.
   There are as many ranges as a range has rows, so neither the ranges of a source nor the rows of one outgrow a task.
2. Targets: water-filling over the sources (one row each): target = min(2 * size, level * weight), where `level` spends the
   budget.  That is the fixed point of sharing the excess anew by weight; each round is a sum.
3. Prefix sums of the ranges' words are offsets; within a range a window adds up the words in order of the key.  A source with
   a third of all words is many ranges, so no task holds a source.
4. Each source is cut at its exact budget: whole epochs first, then the documents in order up to the rest; the last
   document is taken in part.

All is DataFrame functions; the order depends on nothing but the seed and the ids, so reruns agree.

Defined results: a null text has size 0.  A null source is a source, ordered last.  Rows that repeat an id are ordered by
size and text hash, and are taken like others; in `take_mix` rows equal in id, size and text are ordered in one task.  Sources without words have target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ._store import even_cut, hidden, restored, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
COPIES = 5_000  # copies of a row that are spread out together
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, none, source_size), a row per source, with target and budget (target in whole words).

    The level is found by sharing anew among the sources below their most, as long as one more reaches it; a round is a sum over the
    sources, so there may be any number of them.
    """
    spot = numbered(sizes, "spot", "none", "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("spot") % len(WEIGHTS) + 1).cast("int"))
    rows = spot.withColumns({"weight": weight, "cap": F.col("source_size") * MOST}).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        below = F.col("ratio") < level
        n, caps, weights = rows.agg(F.count_if(below), F.coalesce(F.sum(F.when(below, F.col("cap"))), F.lit(0)), F.sum(F.when(~below, F.col("weight")))).first()
        if n == full or not weights:
            break
        level, full = (everything * SHARE - caps) / weights, n
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "none", "source_size", "target", F.floor(F.col("target") + 0.5).alias("budget"))


def mix_documents(docs: DataFrame, text: str | None = "text", seed: int = 5, times: str | None = None) -> DataFrame:
    """Adds size, source_size, target and taken (words) to docs (doc_id, source, text and others, or size without text).

    times: a column that says how often a row counts; such rows are spread out, each copy with what is taken of it.
    """
    ranges = even_cut(docs.count())
    sized = docs if text is None else docs.withColumn("size", words_in(F.col(text)))
    named = lambda value: F.md5(F.concat(F.lit(f"{seed}:"), value))
    digest, unnamed = named(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), named(F.lit(""))
    keyed = sized.withColumns({"_key": digest, "_source": F.coalesce("source", F.lit("")), "_none": F.col("source").isNull()})
    # rows without an id have one key; they are ranges of their own, by size, between what comes before and after that key
    split = {"_range": F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("int"), "_side": F.when(F.col("_key") < unnamed, 0).when(F.col("_key") == unnamed, 1).otherwise(2), "_same": F.when(F.col("doc_id").isNull(), F.col("size")).otherwise(-1)}
    keyed = keyed.withColumns(split)
    words = F.col("size") if times is None else F.col("size") * F.col(times)
    parts = table(keyed.groupBy("_source", "_none", *split).agg(F.sum(words).alias("words")), "ranges")
    sizes = parts.groupBy(F.col("_source").alias("source"), F.col("_none").alias("none")).agg(F.sum("words").alias("source_size"))
    goal = targets(sizes).withColumnsRenamed({"source": "_source", "none": "_none"})
    before = Window.partitionBy("_source", "_none").orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words").join(goal, ["_source", "_none"])
    order = Window.partitionBy("_source", "_none", *split).orderBy("_key", "size", *([] if text is None else [F.xxhash64(text)])).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.join(parts, ["_source", "_none", *split]).withColumn("_start", F.col("_offset") + F.coalesce(F.sum(words).over(order), F.lit(0)))
    if times is not None:
        blocks = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))))
        last = F.least(F.col(times), (F.col("_block") + 1) * COPIES) - 1
        out = blocks.withColumn("_copy", F.explode(F.sequence(F.col("_block") * COPIES, last))).withColumn("_start", F.col("_start") + F.col("_copy") * F.col("size")).drop("_block", "_copy", times)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_start")))
    out = out.withColumn("taken", (F.col("size") * epochs + part).cast("long"))
    return out.drop("_source", "_none", *split, "_key", "_offset", "_start", "budget")


def document_mix(docs: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents.  Equal rows are counted map-side, and go as one until the end."""
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    sized = table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "sizes")
    return mix_documents(sized, None, seed, "times").select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, in time linear in the text: its pieces are split once and bound to a name."""

    def cut(pieces: Column) -> Column:
        upto = F.element_at(F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.element_at(pieces, i) != ""), n.cast("int"))
        return F.substring(text, F.lit(1), F.length(F.array_join(F.slice(pieces, F.lit(1), upto), " ")))

    pieces = F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1)
    return F.element_at(F.transform(F.array(pieces), cut), 1)


def take_mix(docs: DataFrame, seed: int = 5) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document; the one at a budget's end is cut there."""
    mixed = mix_documents(hidden(docs, "doc_id", "source", "text"), "text", seed).where("taken > 0")
    part = F.col("taken") % F.col("size")
    whole = F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    copies = mixed.withColumn("_part", F.explode(F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))))
    cut = copies.withColumn("text", F.when(F.col("_part") > 0, first_words(F.col("text"), F.col("_part"))).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own = F.col(f"_c{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("_part") > 0, F.length("text").cast("long")).otherwise(own)
    return restored(cut, docs.columns, **changed)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, row_number() OVER o AS spot,
        ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
          / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT arg_min(level, spot) AS level FROM l WHERE ratio >= level),
t AS (SELECT source, source_size, least(cap::DOUBLE, f.level * weight) AS target FROM l, f),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('5:' || coalesce(d.doc_id::VARCHAR, '')), d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
        CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * epochs + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM p
"""
