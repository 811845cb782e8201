"""Reading file content on the executors, a bounded piece at a time.

A file is never held whole: its content comes as rows of chunks, and line searches read byte
ranges, so one huge file is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filescape.functions.content import without_cr
from filescape.functions.regex import check_pattern, line_matches
from filescape.operators.grams import GRAM, SEGMENTS, distinct_grams, gram_candidates, segments
from filescape.operators.grep import grep_candidates, in_file_order
from filescape.operators.scope import ext_filter
from filescape.operators.skew import HOT_ROWS, attach
from filescape.session import cut

_CHUNK = 1 << 20
_BATCH_BYTES = 4 << 20
_RANGE_BYTES = 64 << 20
_TASK_BYTES = 256 << 20
_EDGE_BYTES = 64 << 10


def _task_count(files: DataFrame, tasks: int | None) -> int:
    """Tasks that open the files. The listing's own size says nothing about the bytes behind
    it, so they are set by the sizes listed: merged, the rows would end in a few tasks."""
    if tasks:
        return tasks
    least = max(files.sparkSession.sparkContext.defaultParallelism * 4, 8)
    if "size" not in files.columns:
        return least
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(least, -(-total // _TASK_BYTES))


def _spread(files: DataFrame, tasks: int | None, *columns: str) -> DataFrame:
    """Paths, with `columns`, spread evenly before their files are opened."""
    return files.select("path", *columns).repartition(_task_count(files, tasks))


def file_content(
    files: DataFrame,
    skip_errors: bool = False,
    tasks: int | None = None,
    chunk_bytes: int = _CHUNK,
) -> DataFrame:
    """(path, number, content, digest): the chunks of each file, numbered from 0.

    `digest` is the SHA-256 of the file up to the end of the chunk, so the last chunk has
    that of the file. An empty file has one empty chunk. A file is read by one task, one
    chunk in memory at a time.
    """

    def read(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema(
            [("path", pa.string()), ("number", pa.int64()), ("content", pa.binary()), ("digest", pa.string())]
        )
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    state, number = hashlib.sha256(), 0
                    with open(path, "rb") as stream:
                        while (block := stream.read(chunk_bytes)) or not number:
                            state.update(block)
                            row = [[path], [number], [block], [state.copy().hexdigest()]]
                            columns = [pa.array(c, f.type) for c, f in zip(row, schema)]
                            yield pa.RecordBatch.from_arrays(columns, schema=schema)
                            number += 1
                except OSError:
                    if not skip_errors:
                        raise

    return _spread(files, tasks).mapInArrow(read, "path string, number bigint, content binary, digest string")


def _hashed(files: DataFrame, tasks: int | None, column: str, edge: int | None) -> DataFrame:
    """Add `column`, a SHA-256 of each file: of all bytes, or with `edge` of the first and the
    last so many, marked by a leading ~ where bytes between them were left out."""
    chunk = _CHUNK
    others = [name for name in files.columns if name != "path"]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in files.select("path", *others).dtypes)

    def digest_of(path):
        import hashlib
        import os

        state = hashlib.sha256()
        with open(path, "rb") as stream:
            size = os.fstat(stream.fileno()).st_size
            if edge is not None and size > 2 * edge:
                state.update(stream.read(edge))
                stream.seek(size - edge)
                state.update(stream.read(edge))
                return "~" + state.hexdigest()
            while block := stream.read(chunk):
                state.update(block)
        return state.hexdigest()

    def digest(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [digest_of(path) for path in batch.column(0).to_pylist()]
            columns = [*batch.columns, pa.array(keys, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, column])

    hashed = _spread(files, tasks, *others).mapInArrow(digest, f"{schema}, `{column}` string")
    return hashed.select(*files.columns, column)


def file_hashes(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add `dedup_key`, the SHA-256 of each file, read in chunks of constant size."""
    return _hashed(files, tasks, "dedup_key", None)


def hash_files(
    files: DataFrame,
    hash_all: bool = False,
    hot_rows: int = HOT_ROWS,
    tasks: int | None = None,
    edge_bytes: int = _EDGE_BYTES,
) -> DataFrame:
    """Add `dedup_key` to the files of a catalog, in stages.

    Equal content has equal size, and equal first and last `edge_bytes`. Only files whose
    size occurs twice are opened, and only those that share these edges as well are read
    whole; all others get a null key. `hash_all` reads every file.
    """
    if hash_all:
        return file_hashes(files, tasks)

    def marked(rows: DataFrame, keys: list[str]) -> DataFrame:
        groups = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 2")
        return cut(attach(rows, groups.withColumn("_twice", F.lit(True)), keys, "_n", "path", hot_rows=hot_rows))

    sized = marked(files, ["size"])
    opened = _hashed(sized.where("_twice").drop("_twice"), tasks, "_edges", edge_bytes)
    edged = marked(cut(opened), ["size", "_edges"])
    whole = ~F.col("_edges").startswith("~")
    read = file_hashes(edged.where(F.col("_twice") & ~whole).select(*files.columns), tasks)
    known = edged.where(F.col("_twice").isNull() | whole).select(
        *files.columns, F.when(F.col("_twice"), F.col("_edges")).alias("dedup_key")
    )
    unopened = sized.where("_twice is null").select(*files.columns, F.lit(None).cast("string").alias("dedup_key"))
    return read.unionByName(known).unionByName(unopened)


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    """(path, start, stop) of the byte ranges of each file; the last one has no end (-1)."""
    if "size" not in files.columns:
        zero = F.lit(0).cast("bigint")
        return files.select("path", zero.alias("start"), (zero - 1).alias("stop"))
    step = F.lit(range_bytes).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), step)
    cuts = files.select("path", "size", F.explode(starts).alias("start"))
    stop = F.when(F.col("start") + step >= F.col("size"), F.lit(-1).cast("bigint"))
    return cuts.select("path", "start", stop.otherwise(F.col("start") + step).alias("stop"))


def _range_reader(limit: int, skip_errors: bool, lines: bool):
    """Task function over rows (path, start, stop, base, last): the lines that begin in a range.

    A line row has `at`, the newlines between the start of the range and the line, plus
    `base`; lines from number `last` on are left out. A range ends with a row of facts: its
    newlines, whether the file's first line holds a NUL, and `bad`, the place of the first
    line that does not fit. Without `lines` there are only facts.
    """
    batch_bytes, block_bytes, head_bytes = _BATCH_BYTES, _CHUNK, _EDGE_BYTES

    def binary(stream):
        """Whether a NUL comes before the first newline, as far as the head shows."""
        head = stream.read(head_bytes)
        return b"\0" in head.partition(b"\n")[0]

    def next_line(stream, first):
        """The next line, as far as it fits; None for a first line with a NUL."""
        parts, size = [], 0
        while True:
            room = block_bytes if limit < 0 else min(block_bytes, limit - size)
            part = stream.readline(room)
            if first and b"\0" in part:
                return None
            parts.append(part)
            size += len(part)
            if not part or part.endswith(b"\n") or size == limit:
                return b"".join(parts)

    def lines_in(path, start, stop, facts):
        with open(path, "rb") as stream:
            if binary(stream):
                facts["binary"] = True
                return
            stream.seek(max(start - 1, 0))
            if start:  # up to the first line that begins in the range
                while True:
                    part = stream.readline(block_bytes)
                    if not part or part.endswith(b"\n"):
                        break
                    if 0 <= stop <= stream.tell():
                        return
                if part and stream.tell() > start and (stop < 0 or stream.tell() <= stop):
                    facts["newlines"] += 1
            while stop < 0 or stream.tell() < stop:
                raw = next_line(stream, stream.tell() == 0)
                if raw is None:
                    facts["binary"] = True
                    return
                if not raw:
                    return
                closed = raw.endswith(b"\n")
                if not closed and len(raw) == limit:
                    facts["bad"] = facts["newlines"]
                    return
                yield facts["newlines"], raw[:-1] if closed else raw
                if closed and (stop < 0 or stream.tell() <= stop):
                    facts["newlines"] += 1

    def read(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("path", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("raw", pa.binary()),
             ("newlines", pa.int64()), ("binary", pa.bool_()), ("bad", pa.int64())]
        )

        def batch_of(rows):
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
            )

        rows, size = [], 0
        for batch in batches:
            for path, start, stop, base, last in zip(*(column.to_pylist() for column in batch.columns)):
                facts = {"newlines": 0, "binary": False, "bad": None}
                try:
                    for at, raw in lines_in(path, start, stop, facts):
                        if not lines:
                            continue
                        if last is not None and base + at >= last:
                            break
                        rows.append((path, start, base + at, raw, None, None, None))
                        size += len(raw) + 64
                        if size >= batch_bytes:
                            yield batch_of(rows)
                            rows, size = [], 0
                    rows.append((path, start, None, None, *facts.values()))
                    size += 64
                except OSError:
                    if not skip_errors:
                        raise
        yield batch_of(rows)

    return read


_READ = "path string, start bigint, at bigint, raw binary, newlines bigint, binary boolean, bad bigint"


def _bases(facts: DataFrame) -> DataFrame:
    """(path, start, base, last) of the ranges that are searched: the lines before each, by a
    running sum over the file's ranges, and the number of the file's first line that does not
    fit. Ranges of binary files are left out."""
    file = Window.partitionBy("path")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = facts.select(
        "path",
        "start",
        F.coalesce(F.sum("newlines").over(before), F.lit(0)).alias("base"),
        "bad",
        F.max("binary").over(file).alias("_binary"),
    )
    last = F.min(F.col("base") + F.col("bad")).over(file)
    return counted.where(~F.col("_binary")).select("path", "start", "base", last.alias("last"))


def file_lines(
    files: DataFrame,
    max_line_bytes: int | None = None,
    skip_errors: bool = True,
    tasks: int | None = None,
    range_bytes: int = _RANGE_BYTES,
) -> DataFrame:
    """(path, line, text) of text files, read by byte ranges.

    Newlines are counted in a first pass; a second one numbers the lines of each range by
    the newlines before it, so content is never shuffled. A file whose first line holds a
    NUL yields nothing; with `max_line_bytes`, a line that does not fit, its newline
    included, ends its file.
    """
    limit = -1 if max_line_bytes is None else max_line_bytes
    none = F.lit(None).cast("bigint")
    count = _task_count(files, tasks)
    ranges = _ranges(files, range_bytes)
    asked = ranges.select("path", "start", "stop", F.lit(0).cast("bigint").alias("base"), none.alias("last"))
    facts = cut(asked.repartition(count).mapInArrow(_range_reader(limit, skip_errors, False), _READ))
    known = ranges.join(_bases(facts), ["path", "start"]).select("path", "start", "stop", "base", "last")
    read = known.repartition(count).mapInArrow(_range_reader(limit, skip_errors, True), _READ)
    return read.where("raw is not null").select(
        "path", (F.col("at") + 1).alias("line"), without_cr(F.col("raw").cast("string")).alias("text")
    )


def catalog_grams(
    files: DataFrame, skip_errors: bool = True, tasks: int | None = None, range_bytes: int = _RANGE_BYTES
) -> DataFrame:
    """The gram segments of the files of a catalog, read by byte ranges; see `operators.grams`.

    The ranges of a file follow each other in one task, up to `_TASK_BYTES` of them.
    """
    chunk = _CHUNK

    def pieces(path, start, stop):
        """The bytes of a range in pieces that overlap, so that no gram is cut."""
        with open(path, "rb") as stream:
            stream.seek(start)
            tail, left = b"", None if stop < 0 else stop - start + GRAM - 1
            while block := stream.read(chunk if left is None else min(chunk, left)):
                yield tail + block
                tail = (tail + block)[-(GRAM - 1) :]
                left = None if left is None else left - len(block)

    def found(batches):
        import numpy as np

        for batch in batches:
            for path, start, stop in zip(*(column.to_pylist() for column in batch.columns)):
                try:
                    grams = [distinct_grams(piece) for piece in pieces(path, start, stop)]
                except OSError:
                    if not skip_errors:
                        raise
                    continue
                own = grams[0] if len(grams) == 1 else np.unique(np.concatenate([np.zeros(0, np.int32), *grams]))
                yield path, own, not start and stop < 0

    far = F.floor(F.col("start") / F.lit(_TASK_BYTES))
    ranges = _ranges(files, range_bytes).repartition(_task_count(files, tasks), "path", far)
    return ranges.mapInArrow(lambda batches: segments(found(batches)), SEGMENTS)


def grep_catalog(
    files: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    fixed: bool = False,
    exts: str | Iterable[str] = (),
    max_bytes: int | None = None,
    root: str | None = None,
    max_line_bytes: int | None = None,
    tasks: int | None = None,
    range_bytes: int = _RANGE_BYTES,
    grams: DataFrame | None = None,
) -> DataFrame:
    """Matching lines (path, line, text) of the files of a catalog.

    Extension and size filters come first, so files they refuse are never opened. Files
    that cannot be opened are passed over. Files are read once, by byte ranges: only
    matching lines and a row of counts per range are kept, and the counts of the ranges
    before it give a match its line number. With `grams`, an index of the files as they are,
    files that cannot match by it are not opened.
    """
    if not fixed:
        check_pattern(files.sparkSession, pattern, ignore_case)
    wanted = grep_candidates(ext_filter(files, exts), max_bytes)
    candidates = None if grams is None else gram_candidates(grams, pattern, ignore_case, fixed)
    if candidates is not None:
        # read for the number of tasks and for the ranges
        wanted = cut(wanted.join(candidates, "path", "left_semi"))
    limit = -1 if max_line_bytes is None else max_line_bytes
    asked = _ranges(wanted, range_bytes).select(
        "path", "start", "stop", F.lit(0).cast("bigint").alias("base"), F.lit(None).cast("bigint").alias("last")
    )
    read = asked.repartition(_task_count(wanted, tasks)).mapInArrow(_range_reader(limit, True, True), _READ)
    text = without_cr(F.col("raw").cast("string"))
    read = read.withColumn("text", text).drop("raw")
    found = cut(read.where(F.col("text").isNull() | line_matches(F.col("text"), pattern, ignore_case, fixed)))
    bases = _bases(found.where("newlines is not null"))
    line = F.col("base") + F.col("at")
    matches = found.where("text is not null").select("path", "start", "at", "text").join(bases, ["path", "start"])
    kept = matches.where(F.col("last").isNull() | (line < F.col("last")))
    return in_file_order(kept.select("path", (line + 1).alias("line"), "text"), root)
