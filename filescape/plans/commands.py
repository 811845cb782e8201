"""Whole questions about a live tree or a drive listing, put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescape.functions.sizes import size_in_bytes
from filescape.operators import cleanup, dedup, index, patterns, scope, stats, tree
from filescape.operators.grep import grep_too_large
from filescape.session import cut
from filescape.sources import catalog, content, manifest


@dataclass(frozen=True)
class Scan:
    """Results of a scan, each computed when it is used."""

    files: DataFrame
    dirs: DataFrame
    summary: DataFrame
    ext_stats: DataFrame
    largest: DataFrame
    duplicates: DataFrame


def _scan(files: DataFrame, dirs: DataFrame, top: int) -> Scan:
    return Scan(
        files=files,
        dirs=dirs,
        summary=stats.scan_summary(files, dirs),
        ext_stats=stats.ext_stats(files),
        largest=stats.largest_files(files, top),
        duplicates=dedup.duplicate_groups(files),
    )


def scan(spark: SparkSession, root: str, include_all: bool = False, top: int = 10) -> Scan:
    """Totals, types, largest files and duplicates below a directory."""
    nodes = catalog.file_catalog(spark, root, include_all)
    files = cut(content.hash_files(scope.with_types(catalog.catalog_files(nodes))))
    return _scan(files, nodes.where("is_dir"), top)


def scan_drive(
    listing: DataFrame, target: str = "", folder_id: str | None = None, top: int = 10
) -> Scan:
    """The same for a folder of a drive listing, with checksums as duplicate keys."""
    nodes = cut(manifest.manifest_nodes(listing, target, folder_id))
    return _scan(manifest.manifest_files(nodes), nodes.where("is_dir"), top)


def listing(result: Scan, root: str) -> DataFrame:
    """Depth-first listing of a scanned directory with duplicate labels."""
    return tree.tree_listing(dedup.tag_duplicates(result.files), result.dirs, root)


def _live_files(spark: SparkSession, root: str, include_all: bool) -> DataFrame:
    return catalog.catalog_files(catalog.file_catalog(spark, root, include_all))


def find(
    spark: SparkSession,
    root: str,
    exts: str = "",
    name: str = "",
    min_size: str | int = 0,
    max_size: str | int = 0,
    include_all: bool = False,
) -> DataFrame:
    """Files passing the filters, by extension. Nothing is opened."""
    files = _live_files(spark, root, include_all)
    found = scope.find_files(files, exts, name, size_in_bytes(min_size), size_in_bytes(max_size))
    return stats.group_by_ext(found)


def search(spark: SparkSession, root: str, query: str, include_all: bool = False) -> DataFrame:
    """Files whose name holds every word of the query."""
    return index.name_search(_live_files(spark, root, include_all), query).select("path")


def build_index(spark: SparkSession, root: str, include_all: bool = False) -> DataFrame:
    """Postings of all file names, for `save_index` and `index_search`."""
    return index.name_index(_live_files(spark, root, include_all))


def grep(
    spark: SparkSession,
    root: str,
    pattern: str,
    ignore_case: bool = False,
    fixed: bool = False,
    exts: str = "",
    max_size: str | int | None = None,
    include_all: bool = False,
    max_line_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Matching lines, and the files left out for their size."""
    files = _live_files(spark, root, include_all)
    limit = None if max_size is None else size_in_bytes(max_size)
    matches = content.grep_catalog(files, pattern, ignore_case, fixed, exts, limit, root, max_line_bytes)
    return matches, grep_too_large(scope.ext_filter(files, exts), limit)


def mine_patterns(
    spark: SparkSession, root: str, min_group: int = 2, include_all: bool = False
) -> DataFrame:
    """Naming templates and the files that follow them."""
    return patterns.name_patterns(_live_files(spark, root, include_all), min_group)


def clean(result: Scan, decisions: DataFrame | None = None) -> DataFrame:
    """Clean-up plan of a scan; nothing is moved."""
    files = result.files.where(F.col("dedup_key").isNotNull())
    return cleanup.cleanup_plan(files, decisions)
