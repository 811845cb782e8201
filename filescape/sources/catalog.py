"""Listing of a live directory tree."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescape.functions.labels import NOISE_DIRS
from filescape.session import cut

_LISTED = (
    "path string, parent string, name string, is_dir boolean, is_symlink boolean, "
    "size bigint, mtime_us bigint, pending boolean"
)
_FIRST_BUDGET = 1_000
_LAST_BUDGET = 100_000
_BATCH_ROWS = 10_000
_DIRS_PER_TASK = 2_000


def _lister(include_all: bool, skip_errors: bool, budget: int):
    """Task function: list directories, going down until `budget` entries were found.

    Directories found but not yet listed come back as pending, for the next round.
    """
    noise = frozenset(NOISE_DIRS)
    batch_rows = _BATCH_ROWS

    def children(directory):
        import os

        try:
            with os.scandir(directory) as entries:
                for entry in entries:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    if not include_all and (
                        entry.name.startswith(".") or (is_dir and entry.name in noise)
                    ):
                        continue
                    try:
                        entry.path.encode("utf-8")
                        info = entry.stat(follow_symlinks=False)
                    except (OSError, UnicodeEncodeError):
                        if skip_errors:
                            continue
                        raise
                    yield (
                        entry.path,
                        directory,
                        entry.name,
                        is_dir,
                        entry.is_symlink(),
                        0 if is_dir else info.st_size,
                        info.st_mtime_ns // 1000,
                    )
        except OSError:
            if not skip_errors:
                raise

    def expand(batches):
        import pyarrow as pa

        schema = pa.schema(
            [
                ("path", pa.string()),
                ("parent", pa.string()),
                ("name", pa.string()),
                ("is_dir", pa.bool_()),
                ("is_symlink", pa.bool_()),
                ("size", pa.int64()),
                ("mtime_us", pa.int64()),
                ("pending", pa.bool_()),
            ]
        )

        def batch_of(rows):
            columns = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
            )

        rows = []
        for batch in batches:
            for start in batch.column(0).to_pylist():
                waiting, found = [start], 0
                while waiting:
                    directory = waiting.pop()
                    for row in children(directory):
                        found += 1
                        is_dir = row[3]
                        later = is_dir and found >= budget
                        rows.append((*row, later))
                        if is_dir and not later:
                            waiting.append(row[0])
                        if len(rows) >= batch_rows:
                            yield batch_of(rows)
                            rows = []
        yield batch_of(rows)

    return expand


def file_catalog(
    spark: SparkSession,
    root: str,
    include_all: bool = False,
    on_error: str = "fail",
    tasks: int | None = None,
) -> DataFrame:
    """Every file, directory and symbolic link below `root` on a mounted file system.

    Hidden names and noise directories are not listed unless `include_all`. An unreadable
    entry fails the job, or is left out with ``on_error="skip"``. The tree is listed in
    rounds: each task goes down as far as a budget of entries allows, and the directories
    it leaves are spread over all tasks of the next round, so uneven trees balance out.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be fail or skip")
    root = os.path.abspath(root)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    least = tasks or max(spark.sparkContext.defaultParallelism * 4, 8)
    frontier = spark.createDataFrame([(root,)], "path string")
    rounds, budget, waiting = [], _FIRST_BUDGET, 1
    while waiting:
        lister = _lister(include_all, on_error == "skip", budget)
        spread = frontier.repartition(max(least, waiting // _DIRS_PER_TASK)) if rounds else frontier
        listed = cut(spread.mapInArrow(lister, _LISTED))
        rounds.append(listed)
        frontier = listed.where("pending").select("path")
        waiting = frontier.count()
        budget = min(budget * 10, _LAST_BUDGET)
    return reduce(DataFrame.unionByName, rounds).select(
        F.col("path").alias("id"),
        "parent",
        "path",
        "name",
        "is_dir",
        "is_symlink",
        "size",
        F.timestamp_micros("mtime_us").alias("mtime"),
    )


def catalog_files(nodes: DataFrame) -> DataFrame:
    """Regular files of a catalog: no directories, no symbolic links."""
    return nodes.where(~F.col("is_dir") & ~F.col("is_symlink"))
