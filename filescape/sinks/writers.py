"""Writing results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filescape.operators.dedup import duplicate_groups
from filescape.operators.index import POSTINGS_PER_BLOCK, posting_blocks
from filescape.operators.ranking import rank_within
from filescape.operators.scope import with_types
from filescape.operators.stats import group_by_ext

FILES_PER_DOCUMENT = 10_000


def write_output(
    df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists", **options: str
) -> None:
    """Write a result as json, parquet, csv or text. Bad UTF-8 is replaced in json. The
    `options` are those of the format, such as `compression`."""
    if format == "json":
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({name: F.make_valid_utf8(name) for name in text})
    df.write.mode(mode).format(format).options(**options).save(path)


def _documents(
    ranked: DataFrame, keys: list[str], totals: list[str], item, per_document: int
) -> DataFrame:
    block = F.floor((F.col("_rank") - 1) / F.lit(per_document)).cast("bigint")
    return (
        ranked.groupBy(*keys, block.alias("block"))
        .agg(
            *[F.first(c).alias(c) for c in totals],
            F.sort_array(F.collect_list(F.struct("_rank", item.alias("item")))).alias("_items"),
        )
        .select(*keys, *totals, "block", F.col("_items.item").alias("files"))
    )


def find_documents(files: DataFrame, per_document: int = FILES_PER_DOCUMENT) -> DataFrame:
    """{ext, count, size, block, files: [{path, size, type_label}]}.

    An extension with more than `per_document` files is continued in further blocks, each
    with the totals of the whole extension; files are by path through all blocks.
    """
    listed = group_by_ext(files, ordered=False)
    order = ["path", "id"] if "id" in listed.columns else ["path"]
    ranked = rank_within(listed, ["ext"], order, "_rank").withColumnRenamed("ext_count", "count")
    item = F.struct("path", F.col("size").alias("size"), "type_label")
    documents = _documents(ranked, ["ext"], ["count", "ext_size"], item, per_document)
    return documents.withColumnRenamed("ext_size", "size")


def pattern_documents(patterns: DataFrame, per_document: int = FILES_PER_DOCUMENT) -> DataFrame:
    """{template, count, block, files: [{path, fields}]} from `name_patterns`."""
    ranked = rank_within(patterns, ["group_key"], ["path"], "_rank")
    item = F.struct("path", "fields")
    documents = _documents(ranked, ["group_key"], ["template", "count"], item, per_document)
    return documents.drop("group_key")


def write_find_json(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_output(find_documents(files), path, "json", mode)


def write_search_json(found: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """{path} per file found."""
    write_output(found.select("path"), path, "json", mode)


def write_grep_json(matches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """{path, line, text} per match."""
    write_output(matches.select("path", "line", "text"), path, "json", mode)


def grep_text(matches: DataFrame) -> DataFrame:
    """path:line:text per match."""
    return matches.select(
        F.concat_ws(":", "path", F.col("line").cast("string"), "text").alias("value")
    )


def write_grep_text(matches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_output(grep_text(matches), path, "text", mode)


def write_patterns_json(patterns: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_output(pattern_documents(patterns), path, "json", mode)


def _write_counted(df: DataFrame, path: str, mode: str, more: dict[str, int], compression: str = "none", **counts: Column) -> None:
    """Write `df` as json, and next to it, in `<path>_stats`, one row of figures: `more`, and
    `counts`, which are taken in the same pass."""
    seen = Observation()
    write_output(df.observe(seen, *[value.alias(name) for name, value in counts.items()]), path, "json", mode, compression=compression)
    figures = {**more, **{name: seen.get[name] or 0 for name in counts}}
    schema = ", ".join(f"{name} bigint" for name in figures)
    stats = df.sparkSession.createDataFrame([tuple(figures.values())], schema)
    write_output(stats.coalesce(1), f"{path.rstrip('/')}_stats", "json", mode)


def write_index_json(
    index: DataFrame,
    path: str,
    mode: str = "errorifexists",
    block_size: int = POSTINGS_PER_BLOCK,
    files: DataFrame | None = None,
    compression: str = "none",
) -> None:
    """{token, block, paths} per block of a posting list, and the stats {files, tokens,
    postings}. Files without tokens count too, where `files` are given."""
    indexed = index.agg(F.count_distinct("id")) if files is None else files.agg(F.count("*"))
    _write_counted(
        posting_blocks(index, block_size),
        path,
        mode,
        {"files": indexed.first()[0]},
        compression,
        tokens=F.count_if(F.col("block") == 0),
        postings=F.sum(F.size("paths").cast("bigint")),
    )


def tree_rows(nodes: DataFrame) -> DataFrame:
    """Every node with its parent, type and size, the flat form of a tree."""
    typed = with_types(nodes)
    is_dir = F.col("is_dir")
    blank = F.lit("")
    return typed.select(
        "path",
        "parent",
        "name",
        "is_dir",
        "size",
        F.when(is_dir, blank).otherwise(F.col("ext")).alias("ext"),
        F.when(is_dir, blank).otherwise(F.col("type_label")).alias("type_label"),
        *[c for c in ("dedup_key", "dup_label", "mtime") if c in nodes.columns],
    )


def write_tree_json(nodes: DataFrame, path: str, mode: str = "errorifexists", root: str | None = None) -> None:
    """The rows of `tree_rows`, and the stats {dup_groups, wasted_size, files, dirs, size}; the
    row of the `root` is no directory below it. Duplicates need `dedup_key`."""
    dups = {"dup_groups": 0, "wasted_size": 0}
    if "dedup_key" in nodes.columns:
        groups = duplicate_groups(nodes.where(~F.col("is_dir")).select("path", "size", "dedup_key"))
        found = groups.agg(F.count("*"), F.coalesce(F.sum("wasted"), F.lit(0))).first()
        dups = dict(zip(dups, found))
    below = F.col("is_dir") if root is None else F.col("is_dir") & (F.col("path") != (root.rstrip("/") or "/"))
    _write_counted(
        tree_rows(nodes),
        path,
        mode,
        dups,
        files=F.count_if(~F.col("is_dir")),
        dirs=F.count_if(below),
        size=F.sum(F.when(~F.col("is_dir"), F.col("size"))),
    )
