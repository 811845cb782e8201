"""Directories, roll-ups and depth-first order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.functions.names import (
    fold,
    base_name,
    depth,
    in_scope,
    parent_path,
    tree_key,
)
from filescape.functions.sizes import human_size
from filescape.operators.ranking import global_rank
from filescape.operators.scope import with_types
from filescape.session import cut

#: Files whose directories one task adds up, and the tasks that share a directory of very many.
TASK_ROWS, _PIECES = 250_000, 64


def _slashes(path) -> F.Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _with_ancestors(files: DataFrame, root: str, *keep: str) -> DataFrame:
    """One row per file and directory above it, `root` included."""
    top = root.rstrip("/").count("/") + 1
    levels = F.explode(F.sequence(F.lit(top), _slashes(F.col("path"))))
    return files.select("path", *keep, levels.alias("_level")).select(
        F.expr("substring_index(path, '/', _level)").alias("dir"), *keep
    )


def dirs_of(files: DataFrame, root: str, include_all: bool = False) -> DataFrame:
    """Directories below `root` that hold files at any depth, inside the scan scope.

    Pass all files, hidden ones too: a directory of hidden files only still counts.
    """
    dirs = (
        _with_ancestors(files, root)
        .where(F.col("dir") != root.rstrip("/"))
        .distinct()
        .withColumnRenamed("dir", "path")
    )
    if not include_all:
        dirs = dirs.where(in_scope("path", root, F.lit(True)))
    return dirs.withColumn("name", base_name("path"))


def dir_sizes(
    files: DataFrame, root: str, dirs: DataFrame | None = None, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Bytes and files below each directory at any depth.

    With `dirs` (a `path` column), directories without files are listed with 0. Files are
    first added up per directory, so only directories are multiplied by their depth. For that
    they are dealt into tasks of about `task_rows` files, so the directories a task holds do
    not grow with the listing; those of one directory first meet in up to `_PIECES` tasks.
    """
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // task_rows))
    piece = F.pmod(F.xxhash64("path"), F.lit(_PIECES))
    dealt = files.select(parent_path("path").alias("path"), "size", piece.alias("_piece")).repartition(tasks, "path", "_piece")
    pieces = dealt.groupBy("path", "_piece").agg(F.sum("size").alias("size"), F.count("*").alias("files"))
    own = pieces.drop("_piece").repartition(tasks, "path").groupBy("path").agg(
        F.sum("size").alias("size"), F.sum("files").alias("files")
    )
    # a name of its own below each directory makes the directory an ancestor of that
    below = own.withColumn("path", F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/")))
    sizes = (
        _with_ancestors(below, root, "size", "files")
        .groupBy(F.when(F.col("dir") == "", F.lit("/")).otherwise(F.col("dir")).alias("path"))
        .agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    )
    if dirs is None:
        return sizes
    zero = F.lit(0).cast("bigint")
    empty = dirs.select("path", zero.alias("size"), zero.alias("files"))
    return (
        sizes.unionByName(empty)
        .groupBy("path")
        .agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    )


def folder_sizes(nodes: DataFrame) -> DataFrame:
    """`dir_sizes` for rows linked by id: needs `id`, `is_dir`, `size` and `ancestor_ids`.

    Files are first added up per folder, so only folders are multiplied by their depth.
    """
    zero = F.lit(0).cast("bigint")
    own = nodes.where(~F.col("is_dir")).groupBy(F.element_at("ancestor_ids", -1).alias("parent")).agg(
        F.sum("size").alias("size"), F.count("*").alias("files"), F.first("ancestor_ids").alias("above")
    )
    below = own.select(F.explode("above").alias("id"), "size", "files")
    folders = nodes.where("is_dir").select("id", zero.alias("size"), zero.alias("files"))
    return (
        below.unionByName(folders)
        .groupBy("id")
        .agg(F.sum("size").alias("size"), F.sum("files").alias("files"))
    )


def tree_order(nodes: DataFrame, root: str) -> DataFrame:
    """Rows in depth-first order, siblings by lower-case name, a directory before its content."""
    return nodes.orderBy(tree_key("path", root))


def tree_position(nodes: DataFrame, root: str) -> DataFrame:
    """Add `position`, the 1-based place of each row in `tree_order`."""
    keyed = nodes.withColumn("_key", tree_key("path", root))
    return global_rank(keyed, ["_key"], "position").drop("_key")


def tree_listing(files: DataFrame, dirs: DataFrame, root: str) -> DataFrame:
    """Depth-first listing of `root` and the files and directories below it.

    `files` may carry `dup_label`. Last siblings are found by one aggregate per parent and
    joined by path, which is unique, so a directory holding most files causes no skew.
    """
    label = F.col("dup_label") if "dup_label" in files.columns else F.lit("")
    file_rows = with_types(files).select(
        "path", "name", F.lit(False).alias("is_dir"), "size", "type_label", label.alias("dup_label")
    )
    top = root.rstrip("/") or "/"
    with_root = dirs.select("path").unionByName(dirs.sparkSession.createDataFrame([(top,)], "path string"))
    sized = dir_sizes(files, root, with_root)
    dir_rows = sized.select(
        "path",
        base_name("path").alias("name"),
        F.lit(True).alias("is_dir"),
        "size",
        F.lit("").alias("type_label"),
        F.lit("").alias("dup_label"),
    )
    # read twice, for the last siblings and for the rows themselves
    rows = cut(file_rows.unionByName(dir_rows))
    last = (
        rows.where(F.col("path") != top)
        .groupBy(parent_path("path").alias("_parent"))
        .agg(F.max(F.struct(fold("name").alias("folded"), "name", "path")).alias("_last"))
        .select(F.col("_last.path").alias("path"), F.lit(True).alias("_is_last"))
    )
    listed = rows.join(last, "path", "left").select(
        "path",
        depth("path", root).alias("depth"),
        (F.coalesce("_is_last", F.lit(False)) | (F.col("path") == top)).alias("is_last"),
        F.concat("name", F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))).alias("shown"),
        "type_label",
        human_size("size").alias("human_size"),
        "dup_label",
    )
    return listed.orderBy(tree_key("path", root))
