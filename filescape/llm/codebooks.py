"""Vector codes: four codebooks of 256 entries, fitted and applied in whole numbers.

Components become floor(1024 x), and a vector four parts of equal length. The parts of each
position are sorted by Hilbert key and stored once in flat blocks: the parts, the smallest
and largest value of every place (the block's box) and their sums. In every round the
distances between a box and the entries bound those of all parts within: entries farther
from the box than another one's far corner cannot be nearest, and the rest is the block's
short list. A block with one entry on its list gives its sums without its parts being looked
at; the others are worked out by an exact kernel over the short list. Tasks return sums and
counts per entry, which are added by Spark and give the next entries; only the entries, at
most 256 vectors, reach the driver.

The entries are started from the `entries` smallest ids, ascending, and replaced `rounds`
times by floor(sum / count) of the parts nearest to them, ties going to the lower entry;
entries without parts stay.

Vectors that are null or hold a null or a number that is not finite give no row. Repeated
and null ids are rows of their own: null ids come last, equal ones by their vectors. With
fewer rows than entries there are fewer entries. Shorter vectors are filled up with zeros to
the longest, and these to a multiple of four. Whole numbers beyond sqrt(2**58 / length of a
part), 2**27 for 64 components, count as this bound, so that no distance leaves 64 bits.
Null labels are one label. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.llm.packing import hilbert_keys
from filescape.operators.skew import attach
from filescape.session import free

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 256
_LARGEST, _TASK_BYTES, _LEAST_PIECES, _BOX_CELLS = 1 << 30, 64 << 20, 1 << 14, 1 << 20
_KEY_BITS, _MOST_BITS = 62, 8
_EXACT = 1 << 53


def whole_vectors(vectors: DataFrame, vec="vec_id", embedding="embedding", label="label") -> DataFrame:
    """(row, vec_id, label, vector) of the vectors that count."""
    sound = F.col(embedding).isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(_LARGEST))), F.lit(-float(_LARGEST)))).cast("int")
    return vectors.filter(F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec).alias("vec_id"),
        F.col(label).alias("label"),
        F.transform(embedding, whole).alias("vector"),
    )


class _Shape:
    """How vectors are cut into parts, and the cells their Hilbert keys are counted in."""

    def __init__(self, longest: int, first: list[list[int]]):
        self.width = -(-longest // PARTS)
        self.most = math.isqrt((1 << 58) // max(self.width, 1))
        self.entries = self.cut([np.array(v, np.int64) for v in first])
        # the places that differ most among the first entries set the key, never a result
        self.low, self.high = self.entries.min(axis=1), self.entries.max(axis=1)
        self.axes = np.argsort(self.low - self.high, axis=1, kind="stable")[:, : min(self.width, _KEY_BITS // 2)]

    def cut(self, rows: list[np.ndarray]) -> np.ndarray:
        """The parts of vectors as an array (part, row, place)."""
        flat = np.zeros((len(rows), self.width * PARTS), np.int64)
        for line, row in zip(flat, rows):
            line[: len(row)] = row
        return np.clip(flat, -self.most, self.most).reshape(len(rows), PARTS, self.width).transpose(1, 0, 2)

    def keys(self, part: int, pieces: np.ndarray) -> np.ndarray:
        axes = self.axes[part]
        if not len(axes):
            return np.zeros(len(pieces), np.int64)
        bits = max(1, min(_MOST_BITS, _KEY_BITS // len(axes)))
        low, high = self.low[part][axes], self.high[part][axes]
        cell = ((pieces[:, axes] - low) << bits) // np.maximum(high - low + 1, 1)
        return hilbert_keys(np.clip(cell, 0, (1 << bits) - 1), bits)


def _pieces(shape: _Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            parts = shape.cut([values[a:b] for a, b in zip(ends, ends[1:])])
            for part in range(PARTS):
                raw = parts[part].astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), part, np.int32)), pa.array(shape.keys(part, parts[part])), batch.column("row"), _blobs(raw)],
                    ["part", "key", "row", "piece"],
                )

    return run


def _blobs(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a two-dimensional array."""
    step = rows.shape[1] * rows.itemsize
    ends = (np.arange(len(rows) + 1) * step).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _blocks(width: int, block: int):
    """Runs of up to `block` sorted pieces of one part, with their box and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 64 * block:
                table = pa.Table.from_batches(held)
                full = table.num_rows - table.num_rows % block
                yield _packed(table.slice(0, full), width, block)
                held = table.slice(full).combine_chunks().to_batches()
        if held:
            yield _packed(pa.Table.from_batches(held), width, block)

    return run


_BLOCKED = "part int, size int, rows binary, pieces binary, low binary, high binary, sums binary"


def _packed(table: pa.Table, width: int, block: int) -> pa.RecordBatch:
    part, row = table.column("part").to_numpy(), table.column("row").to_numpy()
    values = np.frombuffer(b"".join(table.column("piece").to_pylist()), "<i4").reshape(len(part), width)
    cuts = np.unique(np.concatenate([np.arange(0, len(part), block), np.flatnonzero(np.diff(part)) + 1, [len(part)]]))
    out: list[tuple] = []
    for a, b in zip(cuts, cuts[1:]):
        own = values[a:b].astype(np.int64)
        out.append((int(part[a]), int(b - a), row[a:b].astype("<i8").tobytes(), values[a:b].tobytes(), own.min(axis=0).tobytes(), own.max(axis=0).tobytes(), own.sum(axis=0).tobytes()))
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    names = ["part", "size", "rows", "pieces", "low", "high", "sums"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def short_lists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries (columns) may be nearest to something in each box (rows).

    An entry is out when its distance to the box is more than that of another entry to the
    farthest corner, so ties stay on the list.
    """
    below, above = low[:, None, :] - entries, entries - high[:, None, :]
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1, keepdims=True)


def nearest(pieces: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest nearest entry, squared distance) of every piece, in whole numbers.

    Doubles are used where no sum can exceed what they hold exactly.
    """
    most = max(np.abs(pieces).max(initial=0), np.abs(entries).max(initial=0), 1)
    if 4 * int(most) ** 2 * max(entries.shape[1], 1) < _EXACT:
        pieces, entries = pieces.astype(np.float64), entries.astype(np.float64)
        distance = (pieces * pieces).sum(axis=1)[:, None] - 2 * (pieces @ entries.T) + (entries * entries).sum(axis=1)
    else:
        distance = np.stack([((pieces - entry) ** 2).sum(axis=1) for entry in entries], axis=1)
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(pieces)), best].astype(np.int64)


def _entries_of(batch: pa.RecordBatch, books: np.ndarray):
    """(block's index, part, short list) of every block; boxes of one part are looked at together."""
    _, entries, width = books.shape
    together = max(1, _BOX_CELLS // max(entries * width, 1))
    part = batch.column("part").to_numpy()
    box = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.int64).reshape(len(part), width)
    low, high = box("low"), box("high")
    for own in range(PARTS):
        blocks = np.flatnonzero(part == own)
        for first in range(0, len(blocks), together):
            at = blocks[first : first + together]
            for index, listed in zip(at.tolist(), short_lists(low[at], high[at], books[own])):
                yield index, own, np.flatnonzero(listed)


def _sums(shared):
    """The sums and counts of the parts nearest to each entry, as (cell, total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        width, entries = books.shape[2], books.shape[1]
        totals = np.zeros((PARTS, entries, width + 1), np.int64)
        for batch in batches:
            size = batch.column("size").to_numpy()
            for index, part, listed in _entries_of(batch, books):
                if len(listed) == 1:
                    totals[part, listed[0], :width] += np.frombuffer(batch.column("sums")[index].as_buffer(), np.int64)
                    totals[part, listed[0], width] += size[index]
                else:
                    pieces = np.frombuffer(batch.column("pieces")[index].as_buffer(), "<i4").reshape(size[index], width).astype(np.int64)
                    best, _ = nearest(pieces, books[part][listed])
                    order = np.argsort(best, kind="stable")
                    kinds, first = np.unique(best[order], return_index=True)
                    totals[part, listed[kinds], :width] += np.add.reduceat(pieces[order], first, axis=0)
                    totals[part, listed[kinds], width] += np.diff(np.append(first, len(best)))
        used = np.repeat(totals[:, :, width] > 0, width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(used)), pa.array(totals.ravel()[used])], ["cell", "total"])

    return run


def _codes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        width = books.shape[2]
        for batch in batches:
            size = batch.column("size").to_numpy()
            for index, part, listed in _entries_of(batch, books):
                pieces = np.frombuffer(batch.column("pieces")[index].as_buffer(), "<i4").reshape(size[index], width).astype(np.int64)
                best, distance = nearest(pieces, books[part][listed])
                rows = np.frombuffer(batch.column("rows")[index].as_buffer(), "<i8")
                place = listed[best].astype(np.int64) << (8 * (PARTS - 1 - part))
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(place), pa.array(distance)], ["row", "place", "distance"])

    return run


def _next_entries(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries after one round; at most 256 vectors of sums are read."""
    _, entries, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    cells = blocks.select("part", "size", "pieces", "low", "high", "sums").mapInArrow(_sums(shared), "cell bigint, total bigint")
    totals = np.zeros(PARTS * entries * (width + 1), np.int64)
    for cell, total in cells.groupBy("cell").agg(F.sum("total").alias("total")).collect():
        totals[cell] = total
    shared.unpersist()
    totals = totals.reshape(PARTS, entries, width + 1)
    counts = totals[:, :, width :]
    return np.where(counts > 0, totals[:, :, :width] // np.maximum(counts, 1), books)


def sorted_blocks(rows: DataFrame, shape: _Shape, count: int, block: int = BLOCK) -> DataFrame:
    """The parts of all vectors in blocks along the Hilbert curve of their position; equal
    parts are told apart by their row, so copies spread over blocks and tasks."""
    pieces = rows.select("row", "vector").mapInArrow(_pieces(shape), "part int, key bigint, row bigint, piece binary")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-count * PARTS * (4 * shape.width + 24) // _TASK_BYTES), min(cores, count * PARTS // _LEAST_PIECES))
    order = ["part", "key", "row"]
    line = pieces.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return line.mapInArrow(_blocks(shape.width, block), _BLOCKED)


def encode_vectors(vectors: DataFrame, cut, vec="vec_id", embedding="embedding", label="label", entries: int = ENTRIES,
                   rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error) per vector, codebooks as (part, entry, place)).

    `code` has two hex digits for the entry of each part, `error` is the squared distance,
    `label_error` its sum over the label. `cut` writes a frame that is read again.
    """
    rows = cut(whole_vectors(vectors, vec, embedding, label))
    count, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    first = [r[0] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(min(entries, 256)).select("vector").collect()]
    spark = rows.sparkSession
    if not first:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, np.zeros((PARTS, 0, 0), np.int64)
    shape = _Shape(longest, first)
    blocks = cut(sorted_blocks(rows, shape, count, block))
    books = shape.entries
    for _ in range(rounds):
        books = _next_entries(blocks, books)
    shared = spark.sparkContext.broadcast(books)
    told = blocks.mapInArrow(_codes(shared), "row bigint, place bigint, distance bigint")
    facts = rows.select("row", "vec_id", "label")
    both = told.unionByName(facts, allowMissingColumns=True).groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("place").alias("place"), F.sum("distance").alias("error")
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    coded = cut(both.select("row", "vec_id", "label", F.lower(F.lpad(F.hex("place"), 2 * PARTS, "0")).alias("code"), "error", key.alias("_key")))
    free(blocks, rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy("_key").agg(total.alias("label_error"), F.count("*").alias("_n"))
    return attach(coded, labels, "_key", "_n", "row").select("vec_id", "label", "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the entries' numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
