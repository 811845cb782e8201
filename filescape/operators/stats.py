"""Totals over files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.functions.names import shown_ext
from filescape.operators.dedup import key_totals
from filescape.operators.ranking import sorted_once
from filescape.operators.scope import with_ext, with_types
from filescape.operators.skew import HOT_ROWS, attach

DEFAULT_TOP = 10


def _ext_totals(files: DataFrame) -> DataFrame:
    return (
        with_ext(files)
        .groupBy(shown_ext("ext").alias("ext"))
        .agg(F.count("*").alias("count"), F.sum("size").alias("size"))
    )


def ext_stats(files: DataFrame) -> DataFrame:
    """Number and total size of files per extension, largest total first."""
    return _ext_totals(files).orderBy(F.desc("size"), "ext")


def group_by_ext(files: DataFrame, hot_rows: int = HOT_ROWS, ordered: bool = True) -> DataFrame:
    """One row per file with the totals of its extension.

    Ordered like a grouped report: largest extension first, files by path.
    """
    totals = _ext_totals(files).select(
        "ext", F.col("count").alias("ext_count"), F.col("size").alias("ext_size")
    )
    keep = ["id"] if "id" in files.columns else []
    listed = with_types(files).select(
        shown_ext("ext").alias("ext"), *keep, "path", "size", "type_label"
    )
    # The weight is also a wanted column, so it is passed under a second name.
    weighted = totals.withColumn("_rows", F.col("ext_count"))
    grouped = attach(listed, weighted, "ext", "_rows", "path", hot_rows=hot_rows)
    if not ordered:
        return grouped
    return sorted_once(grouped, ["path"], [F.desc("ext_size"), "ext", "path"])


def find_totals(files: DataFrame) -> DataFrame:
    """One row: number and total size of the files."""
    return files.agg(
        F.count("*").alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")
    )


def largest_files(files: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """The n largest files; ties go by path."""
    return files.orderBy(F.desc("size"), "path").limit(n if n > 0 else DEFAULT_TOP)


def scan_summary(files: DataFrame, dirs: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row: files, directories, bytes, duplicate groups and wasted bytes.

    The totals come from the per-key rows of the duplicate search, so files are read once.
    """
    groups = key_totals(files, key)
    repeated = F.col("copies") >= 2
    from_files = groups.select(
        F.col("files").alias("total_files"),
        F.lit(0).cast("bigint").alias("total_dirs"),
        F.col("bytes").alias("total_size"),
        repeated.cast("bigint").alias("dup_groups"),
        F.when(repeated, F.col("wasted")).otherwise(0).alias("wasted_size"),
    )
    nothing = F.lit(0).cast("bigint")
    from_dirs = dirs.select(
        nothing.alias("total_files"),
        F.lit(1).cast("bigint").alias("total_dirs"),
        nothing.alias("total_size"),
        nothing.alias("dup_groups"),
        nothing.alias("wasted_size"),
    )
    both = from_files.unionByName(from_dirs)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
