"""Exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.functions.content import content_hash
from filescape.operators.ranking import global_rank, rank_within
from filescape.operators.skew import HOT_ROWS, attach
from filescape.session import cut


def with_content_key(files: DataFrame, content: str = "content") -> DataFrame:
    """Replace the content column by `dedup_key`, its hash.

    The hash is taken in the scan stage, so content never enters a shuffle.
    """
    return files.withColumn("dedup_key", content_hash(content)).drop(content)


def group_by_key(files: DataFrame, key: str = "dedup_key", unkeyed: bool = False) -> DataFrame:
    """One row per key: copies, bytes, the first copy by path and the wasted bytes.

    Every aggregate is combined on the map side; no list of copies is built, so a key
    holding most of the files costs no more than any other. Files without a key, known to
    be unique before they were read, are left out or, with `unkeyed`, summed in one row.
    """
    # Copies count keys, so files without one never make a group; a filter on the key would
    # be pushed to the scan and hash the content a second time.
    copies = F.count("*") if unkeyed else F.count(key)
    # An id that repeats the path would double what is shuffled.
    has_id = "id" in files.columns
    first = ["path", "id", "size"] if has_id else ["path", "size"]
    return (
        files.groupBy(F.col(key).alias("dedup_key"))
        .agg(
            copies.alias("copies"),
            F.sum("size").alias("bytes"),
            F.min(F.struct(*first)).alias("_first"),
        )
        .select(
            "dedup_key",
            "copies",
            "bytes",
            F.col("_first.path").alias("first_path"),
            F.col("_first.id" if has_id else "_first.path").alias("first_id"),
            F.col("_first.size").alias("size"),
            ((F.col("copies") - 1) * F.col("_first.size")).alias("wasted"),
        )
    )


def key_totals(files: DataFrame, key: str = "dedup_key") -> DataFrame:
    """(dedup_key, files, copies, bytes, wasted): counts and sums only, which hash.

    Copies of one content have one size. Files without a key have no copies.
    """
    totals = files.groupBy(F.col(key).alias("dedup_key")).agg(
        F.count("*").alias("files"), F.count(key).alias("copies"), F.sum("size").alias("bytes"), F.min("size").alias("_size")
    )
    return totals.select("dedup_key", "files", "copies", "bytes", ((F.col("copies") - 1) * F.col("_size")).alias("wasted"))


def duplicate_groups(files: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Keys with two or more files, by first path, with labels D1, D2, ... in that order."""
    groups = group_by_key(files, key).where("copies >= 2")
    ranked = global_rank(groups, ["first_path", "first_id"], "_rank")
    return ranked.orderBy("_rank").select(
        "dedup_key",
        F.concat(F.lit("D"), F.col("_rank").cast("string")).alias("label"),
        "copies",
        "first_path",
        "first_id",
        "size",
        "wasted",
    )


def wasted_size(files: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row: number of duplicate groups and bytes all copies but one take."""
    groups = key_totals(files, key).where("copies >= 2")
    return groups.agg(
        F.count("*").alias("dup_groups"),
        F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted_size"),
    )


def _spread_column(files: DataFrame) -> str:
    return "id" if "id" in files.columns else "path"


def tag_duplicates(
    files: DataFrame, key: str = "dedup_key", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add `dup_label` to every file: the label of its group, "" for a unique file.

    Files are read twice, to build the groups and to tag, so they are written out first
    and their hashes are taken once.
    """
    files = cut(files)
    facts = duplicate_groups(files, key).select(
        F.col("dedup_key").alias(key), "copies", F.col("label").alias("dup_label")
    )
    tagged = attach(files, facts, key, "copies", _spread_column(files), hot_rows=hot_rows)
    return tagged.withColumn("dup_label", F.coalesce("dup_label", F.lit("")))


def duplicate_members(
    files: DataFrame, key: str = "dedup_key", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Every file of a duplicate group with the group's label and its number in the group."""
    tagged = tag_duplicates(files, key, hot_rows).where("dup_label != ''")
    order = ["path", "id"] if "id" in files.columns else ["path"]
    return rank_within(tagged, [key], order, "copy")
