"""Packing documents into training sequences along a space-filling curve.

Every document becomes a hashed bag-of-tokens vector, the unit vectors are projected to a
few dimensions, and documents are range-sorted by the Hilbert key of the projection, so
documents with similar words lie next to each other. Each range is then cut, in curve
order, into full sequences. What is left at the end of a range is cut into sequences whose
lengths are powers of two, so nothing is padded at all.

A null text is empty; an empty document is its end token alone. Documents of any length
are cut wherever a sequence ends. Rows with the same id are packed as documents of their
own; an empty table gives no rows. Other columns are not looked at.

Words are encoded once per task process and reused: the tokenizer splits at white space
anyway, so the ids of a text are those of its words. Words of letters are encoded many at a
time where the last id of every word can be told from the others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.llm.tables import lists, slices, tidied
from filescape.llm.words import range_hashes, spans

LENGTH = 4096
END = 2
DIMENSIONS, BITS, VECTOR = 3, 16, 256
PARTITION_TOKENS = 8_000_000
_KNOWN_WORDS = 1_500_000
_TAIL = np.isin(np.arange(256), [c for c in range(33, 127) if chr(c) != "'" and not chr(c).isalnum()])


class Encoder:
    """Ids of texts by a tokenizer file; remembers the ids of words it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            parts = json.load(file)
        self.marks = [token["content"].encode() for token in parts.get("added_tokens", [])]
        suffix = parts["model"].get("end_of_word_suffix")
        self.last = None
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[place for token, place in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.separator = self.marks[0].decode() if self.marks else None
        self.separator_id = self.tokenizer.token_to_id(self.separator) if self.separator else None
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text)."""
        data, starts, ends, counts = spans(texts)
        if any(mark in data.tobytes() for mark in self.marks) or not self.separator:
            return self._plain(texts)
        starts, ends, counts = _split_tails(data, starts, ends, counts)
        keys = range_hashes(data, starts, ends)
        distinct, at, own = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            fresh = self.keys[place] != distinct
        else:
            fresh = np.ones(len(distinct), bool)
        if fresh.any():
            self._learn(data, starts[at[fresh]], ends[at[fresh]], distinct[fresh])
        place = np.searchsorted(self.keys, distinct)[own]
        sizes = self.count[place]
        text = np.repeat(np.arange(len(counts)), counts)
        flat = self.ids[_runs(self.first[place], sizes)]
        found = flat, np.bincount(text, weights=sizes, minlength=len(counts)).astype(np.int64)
        if len(self.keys) > _KNOWN_WORDS:
            self.forget()
        return found

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array(one.ids, np.uint32) for one in found]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(one) for one in ids], np.int64)

    def _learn(self, data, starts, ends, keys) -> None:
        raw = data.tobytes()
        plain = _of_letters(data, starts, ends)
        order = np.argsort(~plain, kind="stable")
        words = [raw[a:b].decode() for a, b in zip(starts[order].tolist(), ends[order].tolist())]
        keys, known = keys[order], int(plain.sum())
        found = [self._spaced(words[:known]), self._separated(words[known:])]
        flat, count = (np.concatenate(pair) for pair in zip(*found))
        first = np.cumsum(count) - count + len(self.ids)
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]
        self.ids = np.concatenate([self.ids, flat])

    def _together(self, words: list[str], between: str) -> np.ndarray:
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        found = self.tokenizer.encode_batch_fast([between.join(g) + between for g in groups], add_special_tokens=False)
        return np.concatenate([*(np.array(one.ids, np.uint32) for one in found), np.zeros(0, np.uint32)])

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words that end with the only id that may end a word."""
        if self.last is None:
            return self._separated(words)
        flat = self._together(words, " ")
        stops = np.flatnonzero(self.last[flat])
        if len(stops) != len(words):  # the tokenizer takes words of letters apart
            return self._separated(words)
        return flat, np.diff(stops, prepend=-1)

    def _separated(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat = self._together(words, f" {self.separator} ")
        ends = flat == self.separator_id
        return flat[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters from A to ÿ."""
    found = ((data | 32) >= 97) & ((data | 32) <= 122)
    if len(data):
        pair = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        found[:-1] |= pair
        found[1:] |= pair
    return found


def _of_letters(data, starts, ends) -> np.ndarray:
    others = np.concatenate([[0], np.cumsum(~_letters(data))])
    return others[ends] == others[starts]


def _split_tails(data, starts, ends, counts):
    """Cut the ASCII marks other than ' at the end of a word off where a letter or an ASCII
    digit precedes them: there the tokenizer always splits, and far fewer different words
    remain."""
    cut = ends.copy()
    inside = np.flatnonzero(_TAIL[data[np.maximum(ends - 1, 0)]]) if len(ends) else np.zeros(0, np.int64)
    while len(inside):
        cut[inside] -= 1
        inside = inside[(cut[inside] > starts[inside])]
        inside = inside[_TAIL[data[cut[inside] - 1]]]
    plain = (_letters(data) | (data >= 48) & (data <= 57))[np.maximum(cut - 1, 0)] if len(ends) else np.zeros(0, bool)
    split = (cut < ends) & (cut > starts) & plain
    pieces = 1 + split.astype(np.int64)
    at = np.cumsum(pieces) - pieces
    new_starts, new_ends = np.empty(pieces.sum(), np.int64), np.empty(pieces.sum(), np.int64)
    new_starts[at], new_ends[at] = starts, np.where(split, cut, ends)
    new_starts[at[split] + 1], new_ends[at[split] + 1] = cut[split], ends[split]
    text = np.repeat(np.arange(len(counts)), counts)
    return new_starts, new_ends, np.bincount(text, weights=pieces, minlength=len(counts)).astype(np.int64)


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... of every run, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def _projection(dimensions: int) -> np.ndarray:
    return np.random.default_rng(7).normal(size=(VECTOR, dimensions))


def vectors(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed token counts, square roots taken against very common tokens."""
    slot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    row = np.repeat(np.arange(len(counts)), counts)
    flat = np.bincount(row * VECTOR + slot.astype(np.int64), minlength=len(counts) * VECTOR)
    roots = np.sqrt(flat.reshape(len(counts), VECTOR))
    return roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-12)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates in [0, 2**bits).

    From the highest bit down, a set bit reflects the lower bits of the first axis and a
    clear one swaps them with this axis, which turns the sub-cubes of the curve the same
    way round; a Gray code of the bits read across the axes is the place.
    """
    axes = points.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(len(axes)):
            on = (axes[axis] >> bit) & 1 == 1
            swap = np.where(on, 0, (axes[0] ^ axes[axis]) & low)
            axes[0] ^= np.where(on, low, swap)
            axes[axis] ^= swap
    for axis in range(1, len(axes)):
        axes[axis] ^= axes[axis - 1]
    turn = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    axes ^= turn
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in range(len(axes)):
            key = (key << 1) | ((axes[axis] >> bit) & 1)
    return key


def tokenized(documents: DataFrame, tokenizer: str, doc="doc_id", text="text", dimensions=DIMENSIONS) -> DataFrame:
    """(doc_id, curve, tokens, ids): ids as little-endian unsigned 16-bit numbers where the
    vocabulary allows it, else 32-bit, the end token included."""
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END)
                counts = counts + 1
                unit = 0.5 + 0.5 * np.tanh(vectors(ids, counts) @ _projection(dimensions))
                keys = hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
                stops = np.concatenate([[0], np.cumsum(counts)]) * kind.itemsize
                raw = pa.BinaryArray.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(keys), pa.array(counts), raw], ["doc_id", "curve", "tokens", "ids"]
                )
        encoder.forget()  # the process may go on with another stage

    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id bigint, curve bigint, tokens bigint, ids binary")


def pack(documents: DataFrame, tokenizer: str, cut, doc="doc_id", text="text", length: int = LENGTH,
         partition_tokens: int = PARTITION_TOKENS, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    `ids` (array of int) if asked for. `length` is a power of two. `cut` writes a frame that
    is read again: the sort samples its input before it sorts it."""
    rows = cut(tokenized(documents, tokenizer, doc, text))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = max(1, -(-total // partition_tokens))
    line = rows.withColumn("width", F.expr("octet_length(ids) div tokens").cast("int"))
    # equal keys are told apart by the id, so that copies of a document can be split up
    order = ["curve", "doc_id", "tokens"]
    sorted_rows = line.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return sorted_rows.mapInArrow(tidied(lambda batches: _pack(batches, length, with_ids)), schema + (", ids array<int>" if with_ids else ""))


def _pack(batches: Iterator[pa.RecordBatch], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 40
    held: list[tuple] = []  # pieces of the open sequence
    fill = 0
    out: list[tuple] = []
    for batch in batches:
        names = [batch.column(name).to_pylist() for name in ("doc_id", "tokens", "width")]
        for doc, tokens, width, raw in zip(*names, batch.column("ids")):
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
            start = 0
            while start < tokens:
                size = min(tokens - start, length - fill)
                held.append((doc, start, ids[start : start + size], tokens, fill))
                start, fill = start + size, fill + size
                if fill == length:
                    out += [_piece(p, sequence, p[4], with_ids) for p in held]
                    held, fill, sequence = [], 0, sequence + 1
            if len(out) > 20_000:
                yield _rows(out, with_ids)
                out = []
    # the rest: a sequence for every set bit of what is left
    size, floor = length, 0
    while fill - floor:
        while size > fill - floor:
            size //= 2
        for doc, start, ids, tokens, at in held:
            low, high = max(at, floor), min(at + len(ids), floor + size)
            if low < high:
                out.append(_piece((doc, start + low - at, ids[low - at : high - at], tokens), sequence, low - floor, with_ids))
        floor, sequence = floor + size, sequence + 1
    yield _rows(out, with_ids)


def _piece(piece: tuple, sequence: int, offset: int, with_ids: bool) -> tuple:
    doc, start, ids, tokens = piece[:4]
    row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset)
    return row + (ids,) if with_ids else row


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array([row[i] for row in rows], pa.int64()) for i in range(7)]
    if with_ids:
        flat = np.concatenate([*(row[7] for row in rows), np.zeros(0, np.uint32)]).astype(np.int32)
        arrays.append(lists(flat, np.array([len(row[7]) for row in rows], np.int64)))
    return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
