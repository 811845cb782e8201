"""A gram index of content: which files can hold a match at all.

A gram is three neighbouring bytes of a file, A-Z as a-z. The index comes in segments of a few
thousand files, each with its files numbered, so a posting is a number and no path. A search takes from its pattern the
texts every match must hold; files without their grams are never searched.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.functions.regex import required_literals
from filescape.operators.grep import grep_files
from filescape.session import cut

GRAM = 3
_BLOCK = 1 << 20
#: Postings of a segment, which a task holds at once, and rows of one batch.
SEGMENT_GRAMS, _ROWS = 4_000_000, 2_000
#: Bytes of paths a search of a content table broadcasts at most.
BROADCAST_BYTES = 64 << 20


def distinct_grams(data: bytes):
    """The distinct grams of some bytes as numbers, first byte highest."""
    import numpy as np

    found = []
    for low in range(0, len(data) - GRAM + 1, _BLOCK):
        part = np.frombuffer(data, np.uint8, min(_BLOCK + GRAM - 1, len(data) - low), low).astype(np.int32)
        part += 32 * ((part >= 65) & (part <= 90))
        found.append(np.unique((part[:-2] << 16) | (part[1:-1] << 8) | part[2:]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


class Segment:
    """The grams of some neighbouring files, turned round: a row per gram with the numbers of
    the files that hold it, after a row (gram -1) with the paths of the files by number.
    A file is `whole` unless its other ranges lie elsewhere."""

    def __init__(self):
        self.paths, self.whole, self.grams, self.size = [], [], [], 0

    def add(self, path: str, found, whole: bool = True) -> None:
        if not self.paths or self.paths[-1] != path:
            self.paths.append(path)
            self.whole.append(whole)
        self.grams.append((len(self.paths) - 1, found))
        self.size += len(found) + 16

    def rows(self):
        import uuid

        import numpy as np
        import pyarrow as pa

        grams = np.concatenate([found for _, found in self.grams])
        numbers = np.repeat(np.array([at for at, _ in self.grams], np.int32), [len(found) for _, found in self.grams])
        order = np.argsort(grams, kind="stable")
        grams, numbers = grams[order], numbers[order]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        name, schema = uuid.uuid4().hex, pa.schema(
            [("gram", pa.int32()), ("segment", pa.string()), ("numbers", pa.list_(pa.int32())),
             ("paths", pa.list_(pa.string())), ("whole", pa.list_(pa.bool_()))]
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(([-1], [name], [None], [self.paths], [self.whole]), schema)], schema=schema
        )
        for low in range(0, len(starts), _ROWS):
            ends = np.append(starts, len(grams))[low : low + _ROWS + 1]
            lists = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(numbers[ends[0] : ends[-1]], pa.int32()))
            n = len(lists)
            columns = [pa.array(grams[ends[:-1]], pa.int32()), pa.array([name] * n), lists, pa.nulls(n, schema[3].type), pa.nulls(n, schema[4].type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


SEGMENTS = "gram int, segment string, numbers array<int>, paths array<string>, whole array<boolean>"


def segments(found):
    """The rows of `Segment` for (path, grams, whole) in turn, `SEGMENT_GRAMS` at a time."""
    own = Segment()
    for row in found:
        own.add(*row)
        if own.size >= SEGMENT_GRAMS:
            yield from own.rows()
            own = Segment()
    if own.paths:
        yield from own.rows()


def gram_index(files: DataFrame, content: str = "content") -> DataFrame:
    """The gram segments of a table with a content column. Narrow, no shuffle."""

    def read(batches):
        return segments(
            (path.as_py(), distinct_grams(data.as_py() or b""), True) for batch in batches for path, data in zip(*batch.columns)
        )

    named = files.where(F.col("path").isNotNull())
    return named.select("path", F.col(content).cast("binary").alias("content")).mapInArrow(read, SEGMENTS)


def save_grams(grams: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a gram index; each file is in the order of grams, so that a search reads the pages
    it needs. Nothing is shuffled."""
    grams.sortWithinPartitions("gram").write.mode(mode).parquet(path, compression="zstd")


def literal_grams(literals: Iterable[str]) -> list[int]:
    """The distinct grams of texts of ASCII characters."""
    folded = [text.lower().encode() for text in literals]
    return sorted({int.from_bytes(raw[at : at + GRAM]) for raw in folded for at in range(len(raw) - GRAM + 1)})


def gram_candidates(
    grams: DataFrame, pattern: str, ignore_case: bool = False, fixed: bool = False
) -> DataFrame | None:
    """The paths of the indexed files that may hold a match, once each.

    A file needs all grams of at least one alternative of the pattern. None where an
    alternative has none, as then every file may match.
    """
    needed = [literal_grams(literals) for literals in required_literals(pattern, ignore_case, fixed)]
    if not all(needed):
        return None
    wanted = sorted({gram for own in needed for gram in own})

    def meet(table):
        import numpy as np
        import pyarrow as pa

        rows = table.to_pylist()
        paths = next(row for row in rows if row["gram"] < 0)
        held = np.zeros((len(wanted), len(paths["paths"])), bool)
        for row in rows:
            if row["gram"] >= 0:
                held[wanted.index(row["gram"]), row["numbers"]] = True
        out = []
        whole = np.array(paths["whole"], bool)
        for alternative, own in enumerate(needed):
            mine = held[[wanted.index(gram) for gram in own]]
            for at in np.flatnonzero(np.where(whole, mine.all(0), mine.any(0))):
                out.append((paths["paths"][at], alternative, np.flatnonzero(mine[:, at]).tolist()))
        columns = list(zip(*out)) if out else [[], [], []]
        kinds = [("path", pa.string()), ("alternative", pa.int32()), ("met", pa.list_(pa.int32()))]
        return pa.Table.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, kinds)], schema=pa.schema(kinds))

    asked = grams.where(F.col("gram").isin([-1, *wanted]))
    met = asked.groupBy("segment").applyInArrow(meet, "path string, alternative int, met array<int>")
    sizes = F.element_at(F.array(*[F.lit(len(own)) for own in needed]), F.col("alternative") + 1)
    all_met = F.size(F.array_distinct(F.flatten(F.collect_list("met"))))
    whole = met.groupBy("path", "alternative").agg(all_met.alias("_n")).where(F.col("_n") == sizes)
    return whole.select("path").distinct()


def grep_indexed(
    files: DataFrame,
    grams: DataFrame,
    pattern: str,
    ignore_case: bool = False,
    fixed: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    **options,
) -> DataFrame:
    """`grep_files` over the files that may match by their index.

    The paths to search are broadcast, so content stays in the scan stage. Are they more than
    `broadcast_bytes`, the index spares little and all files are searched. The index has to
    be of the content as it is; files it does not know are not searched.
    """
    candidates = gram_candidates(grams, pattern, ignore_case, fixed)
    if candidates is not None:
        candidates = cut(candidates)
        size = candidates.agg(F.coalesce(F.sum(F.octet_length("path") + 32), F.lit(0))).first()[0]
        if size <= broadcast_bytes:
            files = files.join(F.broadcast(candidates), "path", "left_semi")
    return grep_files(files, pattern, ignore_case, fixed, **options)
