"""A directory tree as a data source: ``spark.read.format("filetree").load(root)``.

Rows are the entries below the root: id, parent, path, name, ext, is_dir, is_symlink, hidden,
size, mtime. `register` makes the source known to a session. Options are applied while the
tree is listed:

- `includeAll`: ``true`` also lists hidden names and noise directories, and what lies below;
  `hidden` tells them. Without it these directories are never opened.
- `exts`, `minSize`, `maxSize`: files only, of these extensions (a comma-separated list) and
  bytes; others are dropped where they are found, before their size and times are looked up.
- `onError`: ``fail``, or ``skip`` for entries that cannot be read.
- `partitions`: about how many directory trees are dealt out.

- `pushFilters`: ``true`` takes conditions on name, extension, kind, size and `hidden` from
  the plan as well, where ``spark.sql.python.filterPushdown.enabled`` is set. Spark 4.1 keeps
  the conditions pushed last for all plans of one frame, so such a frame must be used once
  only; the options above have no such limit.

The planner lists directories level by level until there are enough of them; each partition
then lists a share of these on the executors, so the driver sees names of directories near
the root only. For very uneven trees `catalog.file_catalog` lists in rounds instead.
"""

from __future__ import annotations

import operator
import os
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from filescape.functions.labels import NOISE_DIRS
from filescape.functions.names import fold_text
from filescape.operators.scope import parse_ext_list

SCHEMA = (
    "id string, parent string, path string, name string, ext string, is_dir boolean, "
    "is_symlink boolean, hidden boolean, size bigint, mtime timestamp"
)
_ARROW = pa.schema(
    [
        *((name, pa.string()) for name in ("id", "parent", "path", "name", "ext")),
        *((name, pa.bool_()) for name in ("is_dir", "is_symlink", "hidden")),
        ("size", pa.int64()),
        ("mtime", pa.timestamp("us", tz="UTC")),
    ]
)
_NOISE = frozenset(NOISE_DIRS)
_BATCH_ROWS = 10_000
_DEFAULT_PARTITIONS = 64

# Conditions on an entry, by the class of the filter.
_TESTS = {
    EqualTo: operator.eq,
    EqualNullSafe: operator.eq,
    In: lambda value, some: value in some,
    GreaterThan: operator.gt,
    GreaterThanOrEqual: operator.ge,
    LessThan: operator.lt,
    LessThanOrEqual: operator.le,
    StringContains: lambda value, part: part in value,
    StringStartsWith: str.startswith,
    StringEndsWith: str.endswith,
}
#: Columns in the order in which they become known; none of them is ever null.
_TESTED = ("name", "path", "hidden", "is_dir", "is_symlink", "ext", "size")


def entry_ext(name: str, is_dir: bool) -> str:
    """Lower-cased text from the last dot on; "" for directories and leading dots."""
    at = name.rfind(".")
    return fold_text(name[at:]) if at > 0 and not is_dir else ""


class _Dirs(InputPartition):
    """Directories with whether they are hidden; `deep` lists all below them, else one level."""

    def __init__(self, dirs: list[tuple[str, bool]], deep: bool):
        super().__init__(None)
        self.dirs, self.deep = dirs, deep


class FileTreeReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root = os.path.abspath(options["path"])
        self.skip = options.get("onError", "fail") == "skip"
        self.wanted = int(options.get("partitions", _DEFAULT_PARTITIONS))
        self.prune = str(options.get("includeAll", "false")).lower() != "true"
        self.tests: list[tuple[str, Filter, bool]] = []
        exts = parse_ext_list(options.get("exts", ""))
        least, most = int(options.get("minSize", 0)), int(options.get("maxSize", 0))
        if exts or least or most:
            self._test(EqualTo(("is_dir",), False))
        if exts:
            self._test(In(("ext",), tuple(exts)))
        if least:
            self._test(GreaterThanOrEqual(("size",), least))
        if most:
            self._test(LessThanOrEqual(("size",), most))

    def _test(self, one: Filter, negated: bool = False) -> None:
        self.tests.append((one.attribute[0], one, negated))
        self.tests.sort(key=lambda test: _TESTED.index(test[0]))

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.root):
            raise FileNotFoundError(self.root)
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        near, frontier = [], [(self.root, False)]
        while frontier and len(frontier) < self.wanted:
            below = [found for directory in frontier for found in self._directories(*directory)]
            near += frontier
            frontier = below
        share = max(1, -(-len(frontier) // self.wanted))
        parts = [_Dirs(frontier[i : i + share], True) for i in range(0, len(frontier), share)]
        return ([_Dirs(near, False)] if near else []) + parts

    def read(self, partition: _Dirs) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], list(partition.dirs)
        while waiting:
            directory, hidden = waiting.pop()
            for entry, is_dir, out_of_sight in self._entries(directory, hidden):
                if is_dir and partition.deep:
                    waiting.append((entry.path, out_of_sight))
                row = self._row(entry, directory, is_dir, out_of_sight)
                if row is not None:
                    rows.append(row)
                if len(rows) >= _BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)

    def _entries(self, directory: str, hidden: bool) -> Iterator[tuple[os.DirEntry, bool, bool]]:
        """(entry, is directory, hidden) of a directory, without hidden ones if these are pruned."""
        try:
            with os.scandir(directory) as entries:
                for entry in entries:
                    is_dir = entry.is_dir(follow_symlinks=False)
                    own = hidden or entry.name.startswith(".") or (is_dir and entry.name in _NOISE)
                    if not (self.prune and own):
                        yield entry, is_dir, own
        except OSError:
            if not self.skip:
                raise

    def _directories(self, directory: str, hidden: bool) -> list[tuple[str, bool]]:
        return [(entry.path, own) for entry, is_dir, own in self._entries(directory, hidden) if is_dir]

    def _row(self, entry: os.DirEntry, directory: str, is_dir: bool, hidden: bool) -> tuple | None:
        """The row of an entry, or None if a pushed condition does not hold. The entry's size
        and times are looked up last."""
        known = {"name": entry.name, "path": entry.path, "hidden": hidden, "is_dir": is_dir}
        try:
            for column, test, negated in self.tests:
                if column not in known:
                    known[column] = self._fact(entry, column, is_dir)
                if _TESTS[type(test)](known[column], test.value) == negated:
                    return None
            entry.path.encode("utf-8")
            info = entry.stat(follow_symlinks=False)
            ext, linked = entry_ext(entry.name, is_dir), entry.is_symlink()
        except (OSError, UnicodeEncodeError):
            if self.skip:
                return None
            raise
        size = 0 if is_dir else info.st_size
        return (entry.path, directory, entry.path, entry.name, ext, is_dir, linked, hidden, size, info.st_mtime_ns // 1000)

    def _fact(self, entry: os.DirEntry, column: str, is_dir: bool):
        if column == "ext":
            return entry_ext(entry.name, is_dir)
        if column == "is_symlink":
            return entry.is_symlink()
        return 0 if is_dir else entry.stat(follow_symlinks=False).st_size


class PushingReader(FileTreeReader):
    """A reader that takes conditions from the plan."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            negated, inner = isinstance(one, Not), one.child if isinstance(one, Not) else one
            column = ".".join(inner.attribute)
            if isinstance(inner, IsNotNull) and not negated and column in _TESTED:
                continue  # always so
            if type(inner) not in _TESTS or column not in _TESTED or inner.value is None:
                yield one
                continue
            self._test(inner, negated)
            if column == "hidden" and isinstance(inner, (EqualTo, EqualNullSafe)):
                self.prune |= inner.value == negated  # only what is not hidden is asked for


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileTreeReader:
        if "path" not in self.options:
            raise ValueError("load(root) needs the root of the tree")
        if self.options.get("onError", "fail") not in ("fail", "skip"):
            raise ValueError("onError must be fail or skip")
        pushing = str(self.options.get("pushFilters", "false")).lower() == "true"
        return (PushingReader if pushing else FileTreeReader)(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("filetree")`` known."""
    spark.dataSource.register(FileTree)
