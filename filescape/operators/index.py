"""Inverted index over file names, and search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filescape.functions.names import fold, fold_text, name_tokens
from filescape.operators.ranking import global_rank, sorted_once
from filescape.operators.skew import HOT_ROWS
from filescape.session import cut

POSTINGS_PER_BLOCK = 10_000
#: Blocks of a token that share a slot; a token in more files goes on in further slots.
BLOCKS_PER_SLOT = 16
INDEX_BUCKETS = 64
#: Postings of a token that one task collects.
HOT_POSTINGS = 10_000
#: Sets of query tokens a task tests on the postings of one token.
HOT_SETS = 1000
#: Sketches of 2^16 registers: a standard error of about 0.4 %.
SKETCH_BITS = 16


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order."""
    return list(dict.fromkeys(re.findall("[a-z0-9]+", fold_text(query))))


def _identified(files: DataFrame) -> DataFrame:
    return files if "id" in files.columns else files.withColumn("id", F.col("path"))


def name_index(files: DataFrame) -> DataFrame:
    """Postings (token, id, path, name): one row per token and file. Narrow, no shuffle."""
    tokens = F.explode(F.array_distinct(name_tokens("name")))
    return _identified(files).select(tokens.alias("token"), "id", "path", "name")


def save_index(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store postings sorted by token, so that a search reads the row groups it needs."""
    index.repartitionByRange("token", "path").sortWithinPartitions("token", "path").write.mode(
        mode
    ).parquet(path)


def index_stats(files: DataFrame) -> DataFrame:
    """One row: files indexed and distinct tokens."""
    counted = files.select(
        F.lit(1).cast("bigint").alias("files"), F.lit(None).cast("string").alias("token")
    )
    tokens = name_index(files).select("token").distinct()
    terms = tokens.select(F.lit(0).cast("bigint").alias("files"), "token")
    return counted.unionByName(terms).agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.count("token").alias("tokens")
    )


def token_sketch(files: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One row (files, sketch): the files of a scan and a sketch of their distinct tokens.

    It is a few hundred KB whatever the scan, so scans are kept and merged without their
    names. A scan without tokens has an empty sketch.
    """
    tokens = F.explode_outer(F.array_distinct(name_tokens("name")))
    rows = files.select(tokens.alias("token"), F.lit(None).cast("bigint").alias("files"))
    counted = files.agg(F.count("*").alias("files")).select(F.lit(None).cast("string").alias("token"), "files")
    return rows.unionByName(counted).agg(
        F.sum("files").alias("files"), F.hll_sketch_agg("token", F.lit(bits)).alias("sketch")
    )


def merged_sketch(sketches: DataFrame) -> DataFrame:
    """One row (files, sketch) for several scans together."""
    return sketches.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.hll_union_agg("sketch").alias("sketch")
    )


def sketch_stats(sketches: DataFrame) -> DataFrame:
    """`index_stats` of every sketch, with the number of tokens estimated."""
    return sketches.select("files", F.hll_sketch_estimate("sketch").alias("tokens"))


class StoredIndex:
    """A name index in three tables, for searches that read only what they need.

    - `<name>_files` (number, id, path, name): files numbered by path, bucketed by number.
    - `<name>_tokens` (token, files): bucketed by token.
    - `<name>_blocks` (slot, block, first, last, offsets): posting lists as numbered blocks of
      file numbers. `first` and `last` are the ends of a block, `offsets` the distances from
      `first`. A slot holds `BLOCKS_PER_SLOT` blocks of one token, and blocks are bucketed
      by slot, so a token found in most names is spread over the buckets.

    The tables are bucketed, so joins shuffle only the other side, and a lookup reads the
    buckets of its tokens.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.files, self.tokens, self.blocks = (spark.table(f"{name}_{part}") for part in ("files", "tokens", "blocks"))

    @classmethod
    def build(
        cls, files: DataFrame, name: str, path: str, buckets: int = INDEX_BUCKETS, block_size: int = POSTINGS_PER_BLOCK,
        per_slot: int = BLOCKS_PER_SLOT,
    ) -> StoredIndex:
        """Write the tables below the shared `path` and list them in the catalog as `name`_*.

        The number of blocks in a slot is stored with every token.
        """

        def save(rows: DataFrame, part: str, key: str, *order: str) -> None:
            placed = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
            placed.option("path", f"{path}/{part}").option("compression", "zstd").saveAsTable(f"{name}_{part}")

        listed = _identified(files).select("id", "path", "name")
        save(global_rank(listed, ["path", "id"], "number"), "files", "number")
        spark = files.sparkSession
        numbered = spark.table(f"{name}_files")
        postings = numbered.select(F.explode(F.array_distinct(name_tokens("name"))).alias("token"), "number")
        counts = cut(postings.groupBy("token").agg(F.count("*").alias("files")))
        save(counts.withColumn("per_slot", F.lit(block_size * per_slot).cast("bigint")), "tokens", "token")
        grouped = _blocked(postings, counts, "number", block_size).withColumnRenamed("items", "_numbers")
        offsets = F.transform("_numbers", lambda number: number - F.col("_numbers")[0])
        blocks = grouped.select(
            _slot(F.col("token"), F.floor(F.col("block") / F.lit(per_slot)).cast("bigint")).alias("slot"),
            "block",
            F.element_at("_numbers", 1).alias("first"),
            F.element_at("_numbers", -1).alias("last"),
            offsets.alias("offsets"),
        )
        save(blocks, "blocks", "slot", "block")
        return cls(spark, name)

    def _postings(self, blocks: DataFrame) -> DataFrame:
        """Blocks with a row per file number."""
        numbers = F.transform("offsets", lambda offset: F.col("first") + offset)
        return blocks.withColumn("number", F.explode(numbers)).drop("offsets", "first", "last", "block")

    def search(self, query: str) -> DataFrame:
        """(id, path) of the files whose name holds every token of the query, by path.

        Reads the buckets of the rarest token's slots; the other tokens are tested on names.
        """
        terms = query_terms(query)
        nothing = self.files.where(F.lit(False)).select("id", "path")
        if not terms:
            return nothing
        counts = {r["token"]: r for r in self.tokens.where(F.col("token").isin(terms)).collect()}
        if len(counts) < len(terms):
            return nothing
        rarest = min(terms, key=lambda term: (counts[term]["files"], term))
        row = counts[rarest]
        slots = [f"{rarest}/{at}" for at in range(-(-row["files"] // row["per_slot"]))]
        found = self._postings(self.blocks.where(F.col("slot").isin(slots))).select("number")
        hits, folded = self.files.join(found, "number"), fold("name")
        for term in terms:
            if term != rarest:
                hits = hits.where(_has_term(folded, term))
        return hits.select("id", "path").orderBy("path", "id")

    def search_many(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, path) for a table (query_id, query), one row per query_id.

        Queries with the same tokens are searched once. Each set of tokens asks the slots of
        its rarest token, so those of a frequent token meet in many tasks.
        """
        termed = cut(queries.select("query_id", F.array_sort(F.array_distinct(name_tokens("query"))).alias("terms")))
        sets = termed.select("terms").distinct()
        counted = sets.select("terms", F.explode("terms").alias("token")).join(self.tokens, "token", "left")
        lead = F.min(F.struct(F.coalesce("files", F.lit(0)).alias("files"), "token", "per_slot"))
        rarest = counted.groupBy("terms").agg(lead.alias("lead")).where("lead.files > 0")
        last = F.floor((F.col("lead.files") - 1) / F.col("lead.per_slot")).cast("bigint")
        asked = rarest.select(
            "terms", F.col("lead.token").alias("token"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part")
        ).select("terms", _slot(F.col("token"), F.col("part")).alias("slot"))
        numbers = self._postings(self.blocks.join(asked, "slot")).select("terms", "number")
        named = self.files.join(numbers, "number")
        hits = named.where(F.size(F.array_except("terms", name_tokens("name"))) == 0)
        return termed.join(hits.select("terms", "id", "path"), "terms").select("query_id", "id", "path")


def _slot(token: Column, part: Column) -> Column:
    return F.concat(token, F.lit("/"), part.cast("string"))


def posting_blocks(
    index: DataFrame, block_size: int = POSTINGS_PER_BLOCK, hot_postings: int = HOT_POSTINGS
) -> DataFrame:
    """Posting lists by path, in numbered blocks of at most `block_size` paths.

    A token found in most names gets many blocks instead of one list without bound.
    """
    postings = index.select("token", "path")
    counts = postings.groupBy("token").agg(F.count("*").alias("files"))
    return _blocked(postings, counts, "path", block_size, hot_postings).withColumnRenamed("items", "paths")


def _blocked(
    postings: DataFrame, counts: DataFrame, value: str, block_size: int, hot_postings: int = HOT_POSTINGS
) -> DataFrame:
    """(token, block, items): the values of each token in order, `block_size` to a block.

    `counts` has the postings of each token in `files`. The list of a token with up to
    `hot_postings` is collected in one task and cut. The others are too few to matter, and
    their postings are dealt by ranges of the value: the blocks of a token are collected
    where its values lie in order, and only those that reach into the next range meet again.
    """
    hot = cut(counts.where(F.col("files") > hot_postings).select("token", F.col("files").alias("_files")))
    cold = (
        postings.join(F.broadcast(hot), "token", "left_anti").repartition("token")
        .groupBy("token").agg(F.sort_array(F.collect_list(F.struct(value)))[value].alias("_all"))
    )
    starts = F.sequence(F.lit(0), F.size("_all") - 1, F.lit(block_size))
    cold = cold.select("token", "_all", F.posexplode(starts).alias("block", "_start")).select(
        "token", F.col("block").cast("bigint").alias("block"), F.slice("_all", F.col("_start") + 1, block_size).alias("items")
    )
    if hot.isEmpty():
        return cold
    ranges = cut(
        postings.join(F.broadcast(hot.select("token")), "token").repartitionByRange(value)
        .sortWithinPartitions("token", value).withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_seq", 33))
    )
    before = Window.partitionBy("token").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.groupBy("token", "_range").agg(F.count("*").alias("_n"), F.min("_seq").alias("_first")).select(
        "token", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    # at most tokens with many postings times ranges; with its size known it is broadcast if small
    placed = cut(placed.join(F.broadcast(hot), "token"))
    ranked = ranges.join(placed, ["token", "_range"]).select("token", (F.col("_seq") + F.col("_shift")).alias("_at"), "_files", value)
    kind = postings.schema[value].dataType.simpleString()
    pieces = cut(ranked.mapInArrow(_gather(block_size), f"token string, block bigint, _at bigint, whole boolean, items array<{kind}>"))
    parts = F.sort_array(F.collect_list(F.struct("_at", "items")))
    met = pieces.where("not whole").groupBy("token", "block").agg(F.flatten(parts["items"]).alias("items"))
    return cold.unionByName(pieces.where("whole").select("token", "block", "items")).unionByName(met)


def _gather(block_size: int):
    """Task function over rows (token, place, files of the token, value): neighbours of a block
    as one list, marked as whole if nothing of the block is missing."""

    def gather(batches):
        import numpy as np
        import pyarrow as pa

        names = ["token", "block", "_at", "whole", "items"]

        def listed(table, closed):
            """Lists of the rows, and the rows of the last one unless it is closed."""
            if not table.num_rows:
                return None, table
            token = table.column(0).combine_chunks().dictionary_encode()
            token = token.indices.to_numpy(zero_copy_only=False)
            at = table.column(1).to_numpy()
            block = at // block_size
            new = (np.diff(token) != 0) | (np.diff(block) != 0) | (np.diff(at) != 1)
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])
            if not closed:
                cuts, rest = cuts[:-1], table.slice(cuts[-2])
            else:
                rest = table.slice(table.num_rows)
            if len(cuts) < 2:
                return None, rest
            first, size = cuts[:-1], np.diff(cuts)
            files = table.column(2).to_numpy()[first]
            whole = (at[first] % block_size == 0) & ((size == block_size) | (at[first] + size == files))
            values = table.column(3).slice(0, cuts[-1]).combine_chunks()
            columns = [
                table.column(0).take(pa.array(first)).combine_chunks(), pa.array(block[first]), pa.array(at[first]),
                pa.array(whole), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values),
            ]
            return pa.RecordBatch.from_arrays(columns, names), rest

        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            found, left = listed(table if left is None else pa.concat_tables([left, table]), False)
            if found is not None:
                yield found
        if left is not None:
            found, _ = listed(left, True)
            if found is not None:
                yield found

    return gather


def _has_term(name: Column, term: str) -> Column:
    whole = f"(^|[^a-z0-9]){term}([^a-z0-9]|$)"
    return F.contains(name, F.lit(term)) & name.rlike(whole)


def name_search(files: DataFrame, query: str) -> DataFrame:
    """Files whose name holds every query token as a whole token, by path."""
    terms = query_terms(query)
    if not terms:
        return files.where(F.lit(False))
    folded = fold("name")
    for term in terms:
        files = files.where(_has_term(folded, term))
    return sorted_once(files, ["path"], ["path"])


def index_search(index: DataFrame, query: str) -> DataFrame:
    """`name_search` on stored postings.

    Only the postings of the rarest token are read; the other tokens are tested on their
    names. One count per query token decides which is the rarest.
    """
    terms = query_terms(query)
    counts = index.where(F.col("token").isin(terms)).groupBy("token").count() if terms else None
    found = {row[0]: row[1] for row in counts.collect()} if terms else {}
    if not terms or len(found) < len(terms):
        return index.where(F.lit(False)).select("id", "path")
    rarest = min(terms, key=lambda term: (found[term], term))
    hits, folded = index.where(F.col("token") == rarest), fold("name")
    for term in terms:
        if term != rarest:
            hits = hits.where(_has_term(folded, term))
    return hits.select("id", "path").orderBy("path", "id")


def search_many(
    index: DataFrame, queries: DataFrame, hot_rows: int = HOT_ROWS, hot_sets: int = HOT_SETS
) -> DataFrame:
    """(query_id, id, path) for a table of queries (query_id, query), one row per query_id.

    Queries with the same tokens are searched once. Each set of tokens looks up only its
    rarest one and tests the others on the names found, so common tokens add no rows. Where
    a rarest token has many postings or many sets, both are dealt over a grid of cells with
    at most about `hot_rows` postings and `hot_sets` sets, so no task gets a whole token.
    """
    counts = cut(index.groupBy("token").agg(F.count("*").alias("_n")))
    termed = cut(queries.select("query_id", F.array_sort(F.array_distinct(name_tokens("query"))).alias("terms")))
    lead = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "token")).alias("_lead")
    rarest = cut(
        termed.select("terms").distinct().select("terms", F.explode("terms").alias("token"))
        .join(counts, "token", "left").groupBy("terms").agg(lead)
        .where("_lead._n > 0").select("terms", "_lead.token", "_lead._n")
    )
    grid = rarest.groupBy("token").agg(
        F.ceil(F.first("_n") / F.lit(hot_rows)).cast("int").alias("_rows"),
        F.ceil(F.count("*") / F.lit(hot_sets)).cast("int").alias("_columns"),
    )
    # At most postings / hot_rows and sets / hot_sets tokens are heavy.
    heavy = F.broadcast(grid.where("_rows > 1 or _columns > 1"))
    one = F.lit(1)
    rows, columns = F.coalesce("_rows", one), F.coalesce("_columns", one)

    def dealt(hashed: str, parts):
        return F.pmod(F.xxhash64(hashed), parts).cast("int")

    def every(parts):
        return F.explode(F.sequence(F.lit(0), parts - 1))

    postings = (
        index.join(heavy, "token", "left")
        .withColumn("_row", dealt("id", rows)).withColumn("_column", every(columns)).drop("_rows", "_columns")
    )
    asked = (
        rarest.drop("_n").join(heavy, "token", "left")
        .withColumn("_column", dealt("terms", columns)).withColumn("_row", every(rows)).drop("_rows", "_columns")
    )
    found = postings.join(asked, ["token", "_row", "_column"]).where(
        F.size(F.array_except("terms", name_tokens("name"))) == 0
    )
    return termed.join(found.select("terms", "id", "path"), "terms").select("query_id", "id", "path")
