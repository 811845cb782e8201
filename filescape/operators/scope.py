"""Which files count: scan scope and attribute filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.functions.names import file_ext, fold, fold_text, in_scope, type_label


def with_ext(files: DataFrame) -> DataFrame:
    """Add `ext` where it is missing."""
    return files if "ext" in files.columns else files.withColumn("ext", file_ext("name"))


def with_types(files: DataFrame) -> DataFrame:
    """Add `ext` and `type_label` where they are missing."""
    files = with_ext(files)
    if "type_label" in files.columns:
        return files
    return files.withColumn("type_label", type_label("ext"))


def visible_files(files: DataFrame, root: str, include_all: bool = False) -> DataFrame:
    """Files (and directories, where `is_dir` is there) inside the default scan scope."""
    if include_all:
        return files
    is_dir = F.col("is_dir") if "is_dir" in files.columns else None
    return files.where(in_scope("path", root, is_dir))


def drop_symlinks(nodes: DataFrame) -> DataFrame:
    """All rows but symbolic links."""
    return nodes.where(~F.col("is_symlink"))


def parse_ext_list(text: str) -> list[str]:
    """Extensions of a comma-separated parameter: trimmed, lower case, with their dot."""
    words = [word.strip().lower() for word in text.split(",")]
    return [word if word.startswith(".") else f".{word}" for word in words if word]


def ext_filter(files: DataFrame, exts: str | Iterable[str] = ()) -> DataFrame:
    """Files with one of the extensions; all files when none is given."""
    wanted = parse_ext_list(exts) if isinstance(exts, str) else list(exts)
    files = with_ext(files)
    return files.where(F.col("ext").isin(wanted)) if wanted else files


def name_contains(files: DataFrame, part: str = "") -> DataFrame:
    """Files whose name holds `part`, whatever the case."""
    if not part:
        return files
    return files.where(F.contains(fold("name"), F.lit(fold_text(part))))


def size_range(files: DataFrame, min_size: int = 0, max_size: int = 0) -> DataFrame:
    """Files inside the bounds, both inclusive; 0 leaves a side open."""
    if min_size > 0:
        files = files.where(F.col("size") >= min_size)
    if max_size > 0:
        files = files.where(F.col("size") <= max_size)
    return files


def find_files(
    files: DataFrame,
    exts: str | Iterable[str] = (),
    name: str = "",
    min_size: int = 0,
    max_size: int = 0,
) -> DataFrame:
    """Files passing every filter that is set."""
    sized = size_range(files, min_size, max_size)
    return with_types(name_contains(ext_filter(sized, exts), name))
