"""One query per operator over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filescape.functions import content as content_fn
from filescape.functions import names, sizes
from filescape.operators import cleanup, dedup, grams, grep, index, patterns, ranking, scope, stats, tree
from filescape.plans import views
from filescape.plans.views import DOC_ROOT, LAKE_ROOT, PAGE_ROOT
from filescape.session import shared_path
from filescape.sinks import writers
from filescape.sources import catalog, content, manifest
from filescape.sources.filetree import register as register_filetree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the SQL check shares.
FOLDER_NAME = "NATION_7"
GREP_PATTERN = r"\b(mit|apache|gnu)[[:space:]]+\w*license|[[:digit:]]{3}-[[:digit:]]{4}"
PAGE_PATTERN = r'href="/[[:upper:]][[:alpha:]]+"'
FIXED_TEXT = "License, Version 2.0."
LINE_CAP = 300
LARGE_BYTES = 5000
#: Small enough for most files to have several.
CHUNK_BYTES, RANGE_BYTES, EDGE_BYTES = 1024, 1000, 300
PER_DOCUMENT = 50
POSTINGS_BLOCK = 1000
INDEX_BUCKET_COUNT = 8
SEARCH_TEXT = "Ring small, DAT"
INDEX_TEXT = "part 3 parquet"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_files(spark, sf_dir)


def _visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.visible_files(_docs(spark, sf_dir), DOC_ROOT)


def _typed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.with_types(_docs(spark, sf_dir))


def _keyed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_content_key(_docs(spark, sf_dir)).select(
        "path", "name", "size", "dedup_key"
    )


def _keyed_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.visible_files(_keyed_docs(spark, sf_dir), DOC_ROOT)


def _drive_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_nodes(views.drive_manifest(spark, sf_dir))


def _drive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_files(_drive_nodes(spark, sf_dir))


def _joined(values: Column, separator: str = " ") -> Column:
    return F.array_join(values, separator)


def _tree_on_disk(spark: SparkSession, sf_dir: str) -> str:
    """Write the documents as single files below the shared folder and return the root."""
    from urllib.parse import urlparse

    shared = urlparse(shared_path(spark, "tree"))
    if shared.scheme not in ("", "file"):
        raise RuntimeError("a live tree needs a shared folder that is mounted")
    root = shared.path

    def put(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = root + path
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.part{os.getpid()}"
                with open(part, "wb") as stream:
                    stream.write(text.encode())
                os.replace(part, target)
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    docs = views.doc_files(spark, sf_dir).select("path", "content")
    docs.mapInArrow(put, "files bigint").agg(F.sum("files")).collect()
    return root + DOC_ROOT


# Sources


@query
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    nodes = catalog.file_catalog(spark, root)
    return nodes.select(
        names.relative_path("path", root).alias("path"),
        names.relative_path("parent", root).alias("parent"),
        "name",
        "is_dir",
        "is_symlink",
        "size",
    )


@query
def manifest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = manifest.manifest_source(views.drive_manifest(spark, sf_dir))
    return live.select("id", "name", "parent_id", "mime_type", "size", "md5")


@query
def manifest_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _drive_nodes(spark, sf_dir)
    return nodes.select("id", F.coalesce(F.unix_micros("mtime"), F.lit(-1)).alias("micros"))


@query
def file_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    files = catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))
    chunks = content.file_content(files, chunk_bytes=CHUNK_BYTES)
    whole = chunks.groupBy("path").agg(
        F.sum(F.octet_length("content").cast("bigint")).alias("bytes"),
        F.count("*").alias("chunks"),
        F.max_by("digest", "number").alias("hash"),
    )
    return whole.withColumn("path", names.relative_path("path", root))


@query
def filetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    register_filetree(spark)
    tree_options = {"partitions": 16, "exts": "txt, HTML", "minSize": LARGE_BYTES}
    return spark.read.format("filetree").options(**tree_options).load(root).select(
        names.relative_path("path", root).alias("path"), "name", "ext", "is_symlink", "size"
    )


@query
def live_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    files = catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))
    hashed = content.hash_files(files, edge_bytes=EDGE_BYTES)
    return hashed.select(names.relative_path("path", root).alias("path"), "size", "dedup_key")


@query
def live_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    files = catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))
    found = content.grep_catalog(files, GREP_PATTERN, ignore_case=True, root=root, range_bytes=RANGE_BYTES)
    return found.select(names.relative_path("path", root).alias("path"), "line", "text")


@query
def live_grep_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    files = catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))
    path = _written(spark, "grams", lambda p: grams.save_grams(content.catalog_grams(files, range_bytes=RANGE_BYTES), p))
    found = content.grep_catalog(
        files, FIXED_TEXT, fixed=True, root=root, range_bytes=RANGE_BYTES, grams=spark.read.parquet(path)
    )
    return found.select(names.relative_path("path", root).alias("path"), "line", "text")


@query
def live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree_on_disk(spark, sf_dir)
    files = catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))
    lines = content.file_lines(files, max_line_bytes=LINE_CAP, range_bytes=RANGE_BYTES)
    return lines.select(names.relative_path("path", root).alias("path"), "line", "text")


# Sinks: written to the shared folder and read back


def _written(spark: SparkSession, label: str, write: Callable[[str], None]) -> str:
    # in a folder of its own, so that what a sink writes next to the rows is released with them
    path = f"{shared_path(spark, label)}/rows"
    write(path)
    return path


@query
def find_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope.find_files(_docs(spark, sf_dir))
    documents = writers.find_documents(found, per_document=PER_DOCUMENT)
    path = _written(spark, "find", lambda p: writers.write_output(documents, p))
    back = spark.read.schema(documents.schema).json(path)
    return back.select(
        "ext",
        "count",
        "size",
        "block",
        _joined(F.col("files.path"), "\n").alias("paths"),
        _joined(F.col("files.size").cast("array<string>"), "\n").alias("sizes"),
        _joined(F.col("files.type_label"), "\n").alias("labels"),
    )


@query
def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.name_search(views.part_files(spark, sf_dir), SEARCH_TEXT)
    path = _written(spark, "search", lambda p: writers.write_search_json(found, p))
    return spark.read.schema("path string").json(path)


def _doc_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return grep.grep_files(docs, FIXED_TEXT, fixed=True, root=DOC_ROOT)


@query
def grep_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _doc_matches(spark, sf_dir)
    path = _written(spark, "grep-json", lambda p: writers.write_grep_json(matches, p))
    return spark.read.schema("path string, line bigint, text string").json(path)


@query
def grep_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _doc_matches(spark, sf_dir)
    path = _written(spark, "grep-text", lambda p: writers.write_grep_text(matches, p))
    return spark.read.text(path)


@query
def patterns_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.name_patterns(_docs(spark, sf_dir), ordered=False)
    documents = writers.pattern_documents(found, per_document=PER_DOCUMENT)
    path = _written(spark, "patterns", lambda p: writers.write_output(documents, p))
    back = spark.read.schema(documents.schema).json(path)
    fields = F.transform("files", lambda f: F.array_join(f["fields"], ","))
    return back.select(
        "template",
        "count",
        "block",
        _joined(F.col("files.path"), "\n").alias("paths"),
        _joined(fields, "\n").alias("fields"),
    )


def _index_on_disk(spark: SparkSession, sf_dir: str) -> str:
    files = views.lake_files(spark, sf_dir)
    postings = index.name_index(files)
    return _written(
        spark,
        "index",
        lambda p: writers.write_index_json(postings, p, block_size=POSTINGS_BLOCK, files=files, compression="gzip"),
    )


@query
def index_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _index_on_disk(spark, sf_dir)
    back = spark.read.schema("token string, block bigint, paths array<string>").json(path)
    return back.select("token", "block", _joined("paths", "\n").alias("paths"))


@query
def index_json_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _index_on_disk(spark, sf_dir)
    return spark.read.schema("files bigint, tokens bigint, postings bigint").json(f"{path}_stats")


def _json_tree_on_disk(spark: SparkSession, sf_dir: str) -> str:
    """All documents with their directories, duplicate labels and times written as a tree."""
    docs = views.doc_files(spark, sf_dir)
    mtime = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id"))
    times = docs.select("path", mtime.alias("mtime"))
    files = dedup.tag_duplicates(_keyed_docs(spark, sf_dir)).join(times, "path")
    dirs = tree.dirs_of(docs, DOC_ROOT, include_all=True)
    sized = tree.dir_sizes(files, DOC_ROOT, dirs)
    none = F.lit(None).cast("string")
    rows = files.select("path", "name", "size", "dedup_key", "dup_label", "mtime", F.lit(False).alias("is_dir"))
    rows = rows.unionByName(
        sized.select(
            "path",
            names.base_name("path").alias("name"),
            "size",
            none.alias("dedup_key"),
            none.alias("dup_label"),
            none.cast("timestamp").alias("mtime"),
            F.lit(True).alias("is_dir"),
        )
    )
    nodes = rows.withColumn("parent", names.parent_path("path"))
    return _written(spark, "tree", lambda p: writers.write_tree_json(nodes, p, root=DOC_ROOT))


@query
def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = spark.read.schema(
        "path string, parent string, name string, is_dir boolean, size bigint, ext string, "
        "type_label string, dedup_key string, dup_label string, mtime timestamp"
    ).json(_json_tree_on_disk(spark, sf_dir))
    return back.withColumn("mtime", F.unix_seconds("mtime"))


@query
def tree_json_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _json_tree_on_disk(spark, sf_dir)
    schema = "dup_groups bigint, wasted_size bigint, files bigint, dirs bigint, size bigint"
    return spark.read.schema(schema).json(f"{path}_stats")


@query
def write_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = stats.ext_stats(_typed_docs(spark, sf_dir))
    path = _written(spark, "output", lambda p: writers.write_output(totals, p, "parquet"))
    return spark.read.parquet(path)


# Filters


@query
def visible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible_docs(spark, sf_dir).select("path", "name", "size")


@query
def drop_symlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.doc_files(spark, sf_dir).withColumn("is_symlink", F.col("lang") == "fr")
    return scope.drop_symlinks(nodes).select("path", "size")


@query
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope.ext_filter(_docs(spark, sf_dir), [".txt", ".html"])
    return found.select("path", "ext")


@query
def ext_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope.ext_filter(_docs(spark, sf_dir), " HTML, .log ,,")
    return found.select("path", "ext")


@query
def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.name_contains(_docs(spark, sf_dir), "SRC1").select("path", "name")


@query
def size_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.size_range(views.lake_files(spark, sf_dir), 500_000, 5_000_000).select(
        "path", "size"
    )


def _found_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return scope.find_files(
        docs, "md,html", "EN_", sizes.size_in_bytes("0.3KB"), sizes.size_in_bytes("20k")
    )


@query
def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found_docs(spark, sf_dir).select("path", "size", "ext", "type_label")


@query
def grep_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_too_large(_docs(spark, sf_dir), LARGE_BYTES).select("path", "size")


@query
def text_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    nul = F.lit("\u0000")
    marked = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("a"), nul, F.col("content")))
        .when(F.col("lang") == "de", F.concat(F.col("content"), F.lit("\n"), nul))
        .otherwise(F.col("content"))
    )
    files = _docs(spark, sf_dir).withColumn("content", marked)
    return grep.text_only(files).select("path")


@query
def resolve_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = views.drive_manifest(spark, sf_dir)
    folder_id, _ = manifest.resolve_folder(listing, FOLDER_NAME)
    return listing.where(F.col("id") == folder_id).select("id", "name")


# Derived columns


@query
def file_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_files(spark, sf_dir).select("path", names.file_ext("name").alias("ext"))


@query
def type_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.with_types(views.doc_files(spark, sf_dir)).select("path", "ext", "type_label")


@query
def drive_type_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.drive_manifest(spark, sf_dir).select(
        "id",
        names.drive_ext("name", "mime_type").alias("ext"),
        names.drive_type_label("name", "mime_type").alias("type_label"),
    )


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page_files(spark, sf_dir).select(
        "path", content_fn.content_hash("content").alias("hash")
    )


@query
def drive_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = names.drive_dedup_key("name", "size", "md5")
    return views.drive_manifest(spark, sf_dir).select("id", key.alias("dedup_key"))


def _order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modification times as text in good and bad forms, from the order dates."""
    urgent, high = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    clock = F.date_format("o_orderdate", "HH:mm:ss")
    text = (
        F.when(urgent, F.concat(day, F.lit("T"), clock, F.lit("+02:30")))
        .when(high, F.concat(day, F.lit("T"), clock, F.lit(".250Z")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", day)
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(day, F.lit(" "), clock))
        .otherwise(F.concat(day, F.lit("T"), clock, F.lit("Z")))
    )
    return views.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query
def modified_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(sizes.modified_time("text"))
    return _order_times(spark, sf_dir).select(
        "o_orderkey", "text", F.coalesce(micros, F.lit(-1)).alias("micros")
    )


@query
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size")
    return views.lake_files(spark, sf_dir).select(
        "path",
        sizes.human_size(size).alias("plain"),
        sizes.human_size(F.floor(size / 100_000)).alias("small"),
        sizes.human_size(size * 4096).alias("large"),
        sizes.human_size(size * 100_000_000).alias("huge"),
    )


@query
def parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.when(F.col("p_type") == "ECONOMY", F.lit(" ")).otherwise(F.lit("")),
        F.col("p_size").cast("string"),
        F.when(F.col("p_type") == "SMALL", F.lit(".5")).otherwise(F.lit("")),
        F.element_at(
            F.array(*[F.lit(u) for u in ("", "KB", " MiB", "g", "PiB", ".1.2", " k ", "TB", "x")]),
            (F.col("p_size") % 9 + 1).cast("int"),
        ),
    )
    rows = views.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    parsed = F.coalesce(sizes.parse_size("text"), F.lit(-1))
    return rows.select("p_partkey", "text", parsed.alias("bytes"))


@query
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_files(spark, sf_dir).select(
        "path", _joined(names.name_tokens("name")).alias("tokens")
    )


def _stem() -> Column:
    return names.name_stem("name", names.file_ext("name"))


@query
def name_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.transform(
        names.name_segments(_stem()), lambda s: F.concat(s["kind"], F.lit(":"), s["value"])
    )
    return views.doc_files(spark, sf_dir).select("path", _joined(pieces, "|").alias("segments"))


@query
def name_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_files(spark, sf_dir).select("path", _stem().alias("stem"))


@query
def shape_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_files(spark, sf_dir).select("path", names.shape_key(_stem()).alias("shape"))


@query
def trash_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lake_files(spark, sf_dir).select("path", names.trash_name("path").alias("target"))


@query
def full_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drive_nodes(spark, sf_dir).select("id", "path", "is_dir")


@query
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.doc_files(spark, sf_dir)
    dirs = tree.dirs_of(docs, DOC_ROOT, include_all=True).select("path")
    return tree.tree_position(docs.select("path").unionByName(dirs), DOC_ROOT)


# Joins


@query
def tag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.tag_duplicates(_keyed_docs(spark, sf_dir)).select("path", "size", "dup_label")


@query
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.part_files(spark, sf_dir)
    asked = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()
    queries = asked.select(F.col("query").alias("query_id"), "query")
    return index.search_many(index.name_index(files), queries).select("query_id", "path")


def _stored(spark: SparkSession, files: DataFrame, block_size: int) -> index.StoredIndex:
    """A stored index below the shared folder, under a name of its own."""
    path = shared_path(spark, "names")
    return index.StoredIndex.build(files, f"names_{path.rsplit('-', 1)[-1]}", path, INDEX_BUCKET_COUNT, block_size, per_slot=2)


@query
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, views.lake_files(spark, sf_dir), POSTINGS_BLOCK)
    return stored.search(INDEX_TEXT).select("path")


@query
def stored_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.table(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()
    queries = asked.select(F.col("query").alias("query_id"), "query")
    stored = _stored(spark, views.part_files(spark, sf_dir), POSTINGS_BLOCK)
    return stored.search_many(queries).select("query_id", "path")


# Aggregations


@query
def dir_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.dir_sizes(views.lake_files(spark, sf_dir), LAKE_ROOT)


@query
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = tree.dirs_of(views.doc_files(spark, sf_dir), DOC_ROOT)
    return stats.scan_summary(_keyed_visible(spark, sf_dir), dirs)


@query
def ext_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ext_stats(_docs(spark, sf_dir))


_GROUP_COLUMNS = ["label", "dedup_key", "copies", "first_path", "size", "wasted"]


@query
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(_keyed_docs(spark, sf_dir)).select(*_GROUP_COLUMNS)


@query
def duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = dedup.duplicate_members(_keyed_docs(spark, sf_dir))
    return members.select("dup_label", "copy", "path", "size")


@query
def wasted_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.wasted_size(_keyed_docs(spark, sf_dir))


@query
def group_by_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_by_ext(_docs(spark, sf_dir))


@query
def find_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.find_totals(_found_docs(spark, sf_dir))


@query
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_stats(views.lake_files(spark, sf_dir))


@query
def token_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two scans, merged, next to the exact count of both."""
    scans = [views.lake_files(spark, sf_dir), views.part_files(spark, sf_dir)]
    sketches = index.token_sketch(scans[0]).unionByName(index.token_sketch(scans[1]))
    merged = index.sketch_stats(index.merged_sketch(sketches)).withColumnRenamed("tokens", "estimate")
    exact = index.index_stats(scans[0].select("path", "name").unionByName(scans[1].select("path", "name")))
    within = F.abs(F.col("estimate") - F.col("tokens")) <= F.col("tokens") * 0.02
    return merged.join(exact, "files").select("files", "tokens", within.alias("within"))


@query
def grep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    matches = grep.grep_files(docs, GREP_PATTERN, ignore_case=True, max_bytes=LARGE_BYTES)
    return grep.grep_counts(matches, grep.grep_too_large(docs, LARGE_BYTES))


@query
def drive_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.duplicate_groups(_drive_files(spark, sf_dir))
    kind = F.substring_index("dedup_key", ":", 1)
    return groups.select(*_GROUP_COLUMNS, "first_id", kind.alias("key_kind"))


@query
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.folder_sizes(_drive_nodes(spark, sf_dir))


# Order


@query
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.largest_files(views.lake_files(spark, sf_dir)).select("path", "size")


@query
def sorted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.global_rank(views.lake_files(spark, sf_dir).select("path"), ["path"], "position")


@query
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = tree.dirs_of(views.doc_files(spark, sf_dir), DOC_ROOT)
    tagged = dedup.tag_duplicates(_keyed_visible(spark, sf_dir))
    return tree.tree_listing(tagged, dirs, DOC_ROOT)


# Index and search


@query
def postings_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = index.name_index(views.lake_files(spark, sf_dir))
    return index.index_search(postings, INDEX_TEXT).select("path")


@query
def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.name_index(views.lake_files(spark, sf_dir)).select("token", "path")


@query
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.name_search(views.part_files(spark, sf_dir), SEARCH_TEXT).select("path", "name")


# Content


@query
def grep_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.grep_files(views.page_files(spark, sf_dir), PAGE_PATTERN, root=PAGE_ROOT)


@query
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.split_lines(_docs(spark, sf_dir))


@query
def line_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grep.split_lines(_docs(spark, sf_dir), max_line_bytes=LINE_CAP)


@query
def grep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return grep.grep_files(docs, GREP_PATTERN, ignore_case=True, root=DOC_ROOT)


@query
def grep_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.page_files(spark, sf_dir)
    path = _written(spark, "grams", lambda p: grams.save_grams(grams.gram_index(files), p))
    return grams.grep_indexed(files, spark.read.parquet(path), PAGE_PATTERN, root=PAGE_ROOT)


# Naming templates


@query
def pattern_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.pattern_buckets(_docs(spark, sf_dir))


@query
def varying_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.varying_positions(views.part_files(spark, sf_dir))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query
def split_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.split_position(_docs(spark, sf_dir))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@query
def refine_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.refine_patterns(views.part_files(spark, sf_dir))


def _listed_patterns(found: DataFrame) -> DataFrame:
    return found.select("template", "count", "path", _joined("fields", ",").alias("fields"))


@query
def name_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed_patterns(patterns.name_patterns(views.lake_files(spark, sf_dir)))


@query
def name_patterns_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("path", "name")
    return _listed_patterns(patterns.name_patterns(docs, min_group=3))


# Clean-up


def _decisions(keyed: DataFrame) -> DataFrame:
    """Answers in every form, given by the first digit of the key."""
    digit = F.substring("dedup_key", 1, 1)
    answer = (
        F.when(digit.isin("0", "1", "2"), F.lit("2"))
        .when(digit.isin("3", "4"), F.lit(" s "))
        .when(digit == "5", F.lit("S"))
        .when(digit == "6", F.lit("99"))
        .when(digit == "7", F.lit("x"))
        .when(digit == "8", F.lit(" +2 "))
        .when(digit == "9", F.lit(""))
    )
    answered = keyed.select("dedup_key", answer.alias("answer")).distinct()
    return answered.where("answer is not null")


def _decided_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed_docs(spark, sf_dir)
    return cleanup.cleanup_plan(keyed, _decisions(keyed))


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = cleanup.dedup_keep_first(_keyed_docs(spark, sf_dir))
    return plan.select("dedup_key", "path", "action")


@query
def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided_plan(spark, sf_dir).select("dedup_key", "path", "size", "action", "target")


@query
def cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.cleanup_summary(_decided_plan(spark, sf_dir))


@query
def trash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed_docs(spark, sf_dir)
    flat = F.concat(F.lit("/corpus__"), F.replace(F.substring("path", 9, 2**31 - 1), F.lit("/"), F.lit("__")))
    both = keyed.unionByName(keyed.withColumn("path", flat))
    return cleanup.trash_collisions(cleanup.dedup_keep_first(both))


@query
def unique_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.unique_files(_keyed_docs(spark, sf_dir)).select("dedup_key", "path", "size")
