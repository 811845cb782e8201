"""Mixing sources to target weights by a low-discrepancy schedule.

The points of the golden-ratio sequence are mapped through the cumulative quotas of the
sources, which gives every slot of the mixture a source; slots are ranked within their
source, and slot rank k takes block k of that source, starting over after the last. The
blocks are equal runs of words of the source's documents in a shuffled order that depends
on the seed and the ids only.

A document's size is its number of words; null texts have none. Sources weigh 3, 1, 2, 3,
1, 2, ... in code point order, null last (it is a source of its own). Together the targets
are `share` times all words; a target stops at `most` times its source's words and what is
above is shared again by weight. The last slot of a source takes only the words that are
still missing, so every source gives its target rounded to whole words, and a document of n
words gives at most `most` times n. Rows with the same id are rows of their own; rows that
are equal altogether are interchangeable. Documents without words take part with 0. An
empty table gives no rows. Other columns of the input are not looked at.

Running sums over a source are made of sums within slices of the shuffled order and a sum
over the slices, so no source has to fit a task; only the list of sources is put in order
in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = rf"[\x20\x09-\x0D]*{WORD}"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 512
SLICE_ROWS = 20_000
GOLDEN = (math.sqrt(5) - 1) / 2
#: Cells of the unit interval by which points meet the sources.
CELLS = 4096


def _cell(column: str) -> Column:
    return F.floor(F.col(column) * CELLS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    A source is held at `most` times its size where that is below its share of what the
    sources before it, by size per weight, have left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sources.withColumn("_n", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") - 1) % len(weights) + 1).cast("double")
    )
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "_n")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    limit = (F.col("source_size") * most).cast("double")
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = named.withColumn("_limit", limit).withColumn("_level", level)
    held = F.col("_limit") <= F.col("_level") * F.col("weight")
    first_free = F.min(F.when(~held, F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("_n"), F.col("_level")))).over(
        everything
    )["_level"]
    return leveled.select(
        "source",
        "source_size",
        "weight",
        F.when(held, F.col("_limit")).otherwise(first_free * F.col("weight")).alias("target"),
    )


def shuffled_line(documents: DataFrame, doc="doc_id", source="source", text="text", seed="mix") -> DataFrame:
    """(doc_id, source, size, body, _at): `body` tells texts of one id apart, the place in the shuffled order is the text `_at`."""
    return documents.select(
        F.col(doc).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text)).alias("body"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc).cast("string"), F.lit("")))).alias("_at"),
    )


def with_starts(sized: DataFrame, rows: int) -> DataFrame:
    """Adds `start`. `rows` is the number of rows, which sets the width of a slice."""
    digits = 0
    while rows > SLICE_ROWS * 16**digits:
        digits += 1
    sliced = sized.withColumn("_slice", F.substring("_at", 1, digits) if digits else F.lit(""))
    sums = sliced.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    line = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("source").alias("_source"),
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_sum").over(line), F.lit(0)).alias("_base"),
    )
    inside = (
        Window.partitionBy("source", "_slice")
        .orderBy("_at", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    own = sliced.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_s"))).select(
        "doc_id", "source", "size", "body", (F.col("_base") + F.col("_own")).alias("start")
    )


def quotas(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots and words each source gives: whole passes over its line and a rest."""
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    return (
        goals.withColumn("words", words)
        .withColumn("blocks", blocks)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("long"))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    )


def schedule(quota: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank, block, words): which block each slot of the mixture takes.

    `quota` is a row per source. Slot n belongs to the source whose part of the cumulative
    quotas holds the fractional part of n times the golden ratio. Points beyond a source's
    quota are left out; slots it is short of follow at the end.
    """
    spark = quota.sparkSession
    line = Window.orderBy(F.col("source").asc_nulls_last())
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("slots").over(everything)
    parts = quota.filter("slots > 0").select(
        "*",
        (F.coalesce(F.sum("slots").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / total).alias("low"),
        (F.sum("slots").over(line.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("high"),
    )
    count = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    points = spark.range(count).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % 1.0).alias("point"))
    in_cells = parts.withColumn("_cell", F.explode(F.sequence(_cell("low"), _cell("high"))))
    taken = points.withColumn("_c", _cell("point")).join(
        in_cells, (F.col("_c") == F.col("_cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    )
    run = F.expr(f"slot div {SLICE_ROWS}")
    taken = taken.withColumn("_run", run)
    counts = taken.groupBy("source", "_run").count()
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("source").alias("_source"), F.col("_run").alias("_r"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    ranked = (
        taken.withColumn("_own", F.row_number().over(Window.partitionBy("source", "_run").orderBy("slot")) - 1)
        .join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_run") == F.col("_r")))
        .withColumn("rank", F.col("_base") + F.col("_own"))
        .filter("rank < slots")
        .select("slot", "source", "rank", "source_size", "blocks", "passes", "rest")
    )
    got = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("count").alias("got"))
    short = (
        parts.join(got, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("got < slots")
        .withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)))
        .select(F.lit(None).cast("long").alias("slot"), "source", "rank", "source_size", "blocks", "passes", "rest")
    )
    block = F.expr("rank % blocks")
    whole = F.least(F.lit(block_words), F.col("source_size") - block * block_words)
    last = F.expr("rank div blocks") >= F.col("passes")
    return ranked.unionByName(short).select(
        "slot",
        "source",
        "rank",
        block.alias("block"),
        F.when(last, F.least(whole, F.col("rest") - block * block_words)).otherwise(whole).alias("words"),
    )


def taken_words(line: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, body, start, taken, first_slot): the words the slots take of each
    document, and the first slot that takes one; null where none with a point does."""
    empty = line.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("first_slot", F.lit(None).cast("long"))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    pieces = line.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    # a block is taken whole by all its slots but at most one
    takes = slots.groupBy("source", "block").agg(
        F.count("*").alias("times"), F.min("words").alias("least"), F.max("words").alias("most"), F.min("slot").alias("slot")
    )
    takes = takes.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "times", "least", "most", "slot")
    low = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    part = lambda words: F.greatest(F.least(high, words) - low, F.lit(0))
    joined = pieces.join(takes, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    words = F.when(F.col("times").isNull(), 0).otherwise((F.col("times") - 1) * part(F.col("most")) + part(F.col("least")))
    # the first slot of a block is one that takes it whole, if any does
    slot = F.min(F.when(part(F.col("most")) > 0, F.col("slot")))
    full = joined.groupBy("doc_id", "source", "size", "body", "start").agg(
        F.sum(words).cast("long").alias("taken"), slot.cast("long").alias("first_slot")
    )
    return full.unionByName(empty.select(*full.columns))


def mix_sources(documents: DataFrame, cut, doc="doc_id", source="source", text="text", seed="mix", block_words: int = BLOCK_WORDS):
    """(documents with their taken words, schedule, targets); `cut` writes a frame that is read again.

    The first frame has doc_id, source, size, body, start, source_size, target, taken and first_slot.
    """
    sized = cut(shuffled_line(documents, doc, source, text, seed))
    goals = cut(quotas(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), block_words))
    rows = sized.count()
    line = with_starts(sized, rows)
    slots = schedule(goals, block_words)
    mixed = taken_words(line, slots, block_words)
    named = goals.select(F.col("source").alias("_source"), "source_size", "target", "rest", "passes")
    out = mixed.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out, slots, goals


def mixed_documents(documents: DataFrame, cut, doc="doc_id", source="source", text="text", chars="n_chars", **options) -> DataFrame:
    """The rows of the mixture with the columns of `documents`: a document once for every time
    its blocks are taken whole. In the last pass over a source the blocks end inside one
    document, which gives its words up to there, with what stands between them."""
    mixed, _, _ = mix_sources(documents, cut, doc, source, text, **options)
    taken = mixed.filter("taken > 0").select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("body").alias("_body"), F.col("size").alias("_size"), F.col("taken").alias("_taken")
    )
    rows = documents.withColumn("_text_body", F.xxhash64(F.col(text))).dropDuplicates([doc, source, "_text_body"])
    same = F.col(doc).eqNullSafe(F.col("_doc")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("_text_body") == F.col("_body"))
    spaced = F.regexp_extract_all(F.col(text), F.lit(SPACED_WORD), F.lit(0))
    part = F.array_join(F.slice(spaced, 1, F.expr("cast(_taken % _size as int)")), "")
    whole = F.expr("cast(_taken div _size as int)")
    texts = F.concat(F.array_repeat(F.col(text), whole), F.when(F.expr("_taken % _size > 0"), F.array(part)).otherwise(F.array().cast("array<string>")))
    out = rows.join(taken, same).withColumn(text, F.explode(texts))
    return out.withColumn(chars, F.length(text).cast("long")).select(*documents.columns)
