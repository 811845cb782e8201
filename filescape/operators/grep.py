"""Line-level content search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.functions.content import is_text, raw_lines, searchable_lines, without_cr
from filescape.functions.names import tree_key
from filescape.functions.regex import check_pattern, line_matches
from filescape.operators.ranking import sorted_once
from filescape.operators.scope import ext_filter


def grep_too_large(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files a search leaves out for their size; none without a limit."""
    return files.where(F.lit(False) if max_bytes is None else F.col("size") > max_bytes)


def grep_candidates(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files a search reads."""
    return files if max_bytes is None else files.where(F.col("size") <= max_bytes)


def grep_cut_off(files: DataFrame, max_line_bytes: int | None, content: str = "content") -> DataFrame:
    """Files of which a search leaves out lines, from the first that does not fit."""
    if max_line_bytes is None:
        return files.where(F.lit(False))
    return files.where(F.exists(raw_lines(content), lambda line: F.octet_length(line) >= max_line_bytes))


def text_only(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose first line holds no NUL."""
    return files.where(is_text(content))


def split_lines(
    files: DataFrame,
    content: str = "content",
    max_line_bytes: int | None = None,
) -> DataFrame:
    """(path, line, text) for every line, numbered from 1.

    With `max_line_bytes`, a line that does not fit ends its file; `grep_cut_off` lists
    these files.
    """
    lines = F.posexplode(searchable_lines(content, max_line_bytes)).alias("_at", "_raw")
    return files.select("path", lines).select(
        "path", (F.col("_at") + 1).cast("bigint").alias("line"), without_cr("_raw").alias("text")
    )


def grep_lines(
    lines: DataFrame, pattern: str, ignore_case: bool = False, fixed: bool = False
) -> DataFrame:
    """Rows of (path, line, text) whose text matches."""
    return lines.where(line_matches(F.col("text"), pattern, ignore_case, fixed))


def grep_files(
    files: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    fixed: bool = False,
    exts: str | Iterable[str] = (),
    max_bytes: int | None = None,
    root: str | None = None,
    content: str = "content",
    max_line_bytes: int | None = None,
) -> DataFrame:
    """Matching lines (path, line, text) of a table with a content column.

    All lines of all files are searched unless a limit is given; `grep_too_large` and
    `grep_cut_off` tell what a limit leaves out. Ordered by line in depth-first file order below `root`, or by path without a root.
    Only the final order shuffles, and it moves matches, not content.
    """
    if not fixed:
        check_pattern(files.sparkSession, pattern, ignore_case)
    searched = text_only(grep_candidates(ext_filter(files, exts), max_bytes), content)
    if fixed and not ignore_case:
        searched = searched.where(F.contains(F.col(content), F.lit(pattern)))
    matches = grep_lines(split_lines(searched, content, max_line_bytes), pattern, ignore_case, fixed)
    return in_file_order(matches, root)


def in_file_order(matches: DataFrame, root: str | None) -> DataFrame:
    """Matches by line in depth-first file order. The files are read once."""
    key = tree_key("path", root) if root else F.col("path")
    return sorted_once(matches, ["path", "line"], [key, "line"])


def grep_counts(matches: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: matching lines and files skipped for their size."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    both = matches.select(one.alias("matches"), zero.alias("skipped")).unionByName(
        skipped.select(zero.alias("matches"), one.alias("skipped"))
    )
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])
