"""Suffix-array dedup: bytes covered by strings that also start in an earlier document.

0. A text that an earlier document has too is covered altogether and stands aside.
1. Every window of `length` bytes has a key that depends on its bytes alone, and neighbours
   with one key form a run. Only keys that occur in several texts go on.
2. The strings of runs with one key meet in one task, equal strings once. Their stretches of
   windows that another string may have are sorted by `suffix.suffix_array`, equal ones once;
   suffixes that agree in `length` bytes lie next to each other there, and the smallest
   document of each such group is known. A key with very many different strings is dealt out
   by the windows themselves.
3. Every occurrence compares its document with the smallest one of its windows, and the
   bytes of the windows that came earlier are cut out.

A null text is empty. Documents with fewer bytes than a window lose nothing. An id that is
null counts as larger than all others; rows with equal ids do not repeat each other. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescape.llm.suffix import suffix_array
from filescape.llm.tables import bytes_of, slices, tidied
from filescape.llm.words import mix, range_hashes, window_hashes
from filescape.session import free

LENGTH, GRAM = 50, 20
_LONGEST_RUN = 128
_CHUNK_KEYS = 1_000_000
#: Bytes sorted at once, bytes whose windows are compared before, and strings of one key from
#: which its windows are dealt out.
SORT_BYTES, MARK_BYTES, HOT_STRINGS = 1 << 16, 1 << 18, 20_000
_LAST = (1 << 63) - 1


def runs(texts: pa.Array, length: int = LENGTH, gram: int = GRAM):
    """(document, start, windows, key) of runs of neighbouring windows with one key.

    A window is a string of `length` bytes inside a document; its key is the smallest hash
    of the strings of `gram` bytes in it, so equal windows have equal keys wherever they are.
    """
    data, bounds = bytes_of(texts)
    count = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none, np.zeros(0, np.uint64), data, bounds
    low = window_hashes(data, gram)
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    key = np.minimum(low[:count], low[span - width : span - width + count])
    ends = np.repeat(bounds[1:], np.diff(bounds))[:count]
    valid = np.arange(count) + length <= ends
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:count]
    fresh = np.ones(count, bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    stop = np.flatnonzero(valid & np.append(~valid[1:] | fresh[1:], True)) + 1
    size = stop - first
    parts = -(-size // _LONGEST_RUN)
    if (parts > 1).any():
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, stop = np.repeat(first, parts) + step * _LONGEST_RUN, np.repeat(stop, parts)
        size = np.minimum(stop - first, _LONGEST_RUN)
    return row[first], first, size, key[first], data, bounds


def _order(doc: str) -> Column:
    """Ids as places in the order of documents, null last."""
    return F.coalesce(F.col(doc).cast("long"), F.lit(_LAST))


def window_keys(documents: DataFrame, doc: str, text: str, length: int, gram: int) -> DataFrame:
    """(key, salt, known, body): the keys of all documents; `body` is a hash of the text, so
    copies count once.

    A key that several texts of a run of documents have is known to be shared: their rows
    are spread by salt, and one row tells the other tasks.
    """

    def flush(keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        key, place = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        key, place = key[fresh], place[fresh]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(key)))
        shared = np.repeat(size > 1, size)
        salt = np.where(shared, 1 + (place & 1023), 0)
        told = first & shared
        columns = [
            np.concatenate([key, key[told]]).view(np.int64),
            np.concatenate([salt, np.zeros(told.sum(), np.int64)]),
            np.concatenate([np.zeros(len(key), bool), np.ones(told.sum(), bool)]),
            np.concatenate([place, place[told]]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "salt", "known", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                row, _, _, key, _, _ = runs(part.column("text"), length, gram)
                keys.append(key)
                docs.append(part.column("body").to_numpy()[row])
                held += len(key)
                if held >= _CHUNK_KEYS:
                    yield flush(keys, docs)
                    keys, docs, held = [], [], 0
        if keys:
            yield flush(keys, docs)

    rows = documents.select(F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), "key bigint, salt bigint, known boolean, body bigint")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, key) where other texts have the key, from rows sorted by key."""

    def complete(rows: pa.Table) -> pa.RecordBatch:
        key, place, known = (rows.column(name).to_numpy() for name in ("key", "body", "known"))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            several = np.zeros(0, bool)
        else:
            several = np.logical_or.reduceat(known, starts) | (
                np.minimum.reduceat(place, starts) != np.maximum.reduceat(place, starts)
            )
        kept = np.repeat(several, np.diff(np.append(starts, len(key)))) & ~known
        return pa.RecordBatch.from_arrays([pa.array(place[kept]), pa.array(key[kept])], ["body", "key"])

    rest = None
    for batch in batches:
        salted = batch.column("salt").to_numpy() > 0
        passed = batch.filter(pa.array(salted))
        yield pa.RecordBatch.from_arrays([passed.column("body"), passed.column("key")], ["body", "key"])
        open_ = pa.Table.from_batches([batch.filter(pa.array(~salted))])
        rest = open_ if rest is None else pa.concat_tables([rest, open_]).combine_chunks()
        if rest.num_rows:
            key = rest.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            yield complete(rest.slice(0, last))
            rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield complete(rest)


def shared_keys(keys: DataFrame) -> DataFrame:
    dealt = keys.repartition("key", "salt").sortWithinPartitions("key")
    return dealt.mapInArrow(_shared, "body bigint, key bigint")


def texts_of(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, body, sum, bytes) per document; body and sum together stand for the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        _order(doc).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.crc32(content.cast("binary")).alias("sum"), F.octet_length(content).cast("long").alias("bytes")
    )


def occurrences(documents: DataFrame, firsts: DataFrame, shared: DataFrame, doc: str, text: str, length: int, gram: int) -> DataFrame:
    """(doc, body, start, windows, key, content, string, last): runs whose key is shared, of the
    first document of each text, as listed in `firsts` (doc, body).

    `body` tells texts of one id apart, `content` is a hash of the run's bytes, and `string`
    holds the bytes where they are the first of their content in a run of documents, whose
    largest document with that content is `last`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, start, size, key, data, bounds = runs(part.column("text"), length, gram)
                wanted = part.column("keys")
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                kept = np.zeros(len(row), bool)
                for at in range(part.num_rows):
                    own = slice(ends[at], ends[at + 1])
                    kept[own] = np.isin(key[own].view(np.int64), wanted[at].values.to_numpy())
                row, start, size, key = row[kept], start[kept], size[kept], key[kept]
                content = range_hashes(data, start, start + size + length - 1, fold=False)
                place = part.column("doc").to_numpy()[row]
                order = np.lexsort((place, content, key))
                first = np.ones(len(order), bool)
                first[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
                told = np.zeros(len(order), bool)
                told[order[first]] = True
                last = place.copy()
                if len(order):
                    last[order[first]] = np.maximum.reduceat(place[order], np.flatnonzero(first))
                raw = data.tobytes()
                strings = [raw[a:b] if t else None for a, b, t in zip(start.tolist(), (start + size + length - 1).tolist(), told.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(place), pa.array(part.column("body").to_numpy()[row]), pa.array((start - bounds[row]).astype(np.int64)),
                        pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(strings, pa.binary()),
                        pa.array(last, mask=~told),
                    ],
                    ["doc", "body", "start", "windows", "key", "content", "string", "last"],
                )

    texts = documents.select(_order(doc).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    keys = shared.groupBy("body").agg(F.collect_set("key").alias("keys"))
    wanted = firsts.select("doc", "body").join(keys, "body")
    schema = "doc bigint, body bigint, start bigint, windows int, key bigint, content bigint, string binary, last bigint"
    return texts.join(wanted, ["doc", "body"]).mapInArrow(tidied(run), schema)


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                string = batch.column("string")[at].as_py()
                pieces = [string[i : i + length] for i in range(len(string) - length + 1)]
                count = len(pieces)
                dealt = [int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big", signed=True) for piece in pieces]
                same = {name: [batch.column(name)[at].as_py()] * count for name in ("key", "content", "low", "last")}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealt, pa.int64()), pa.array(same["key"], pa.int64()), pa.array(same["content"], pa.int64()),
                     pa.array(list(range(count)), pa.int32()), pa.array(same["low"], pa.int64()), pa.array(same["last"], pa.int64()), pa.array(pieces, pa.binary())],
                    ["dealt", "key", "content", "base", "low", "last", "string"],
                )

    return run


def hot_keys(strings: DataFrame, hot_strings: int = HOT_STRINGS) -> DataFrame:
    """(key): at most one for every `hot_strings` strings, which is what is sent to all tasks."""
    return strings.groupBy("key").count().filter(F.col("count") > hot_strings).select("key")


def first_documents(strings: DataFrame, length: int, gram: int, hot_strings: int = HOT_STRINGS, hot: DataFrame | None = None) -> DataFrame:
    """(key, content, lo, hi, low): the windows lo..hi-1 of a content start first in document `low`.

    `strings` has key, content, low, last and string: the smallest and the largest document
    known to have the content. Windows that start in no document before the largest one with
    their content have nothing to remove and are left out. `hot` are the
    `hot_keys`, where they are known; no string is dealt only to be told from theirs.
    """
    schema = "dealt bigint, key bigint, content bigint, base int, low bigint, last bigint, string binary"
    plain = strings.select(F.col("key").alias("dealt"), "key", "content", F.lit(0).alias("base"), "low", "last", "string")
    hot = hot_keys(strings, hot_strings) if hot is None else hot
    if not hot.isEmpty():
        split = plain.join(F.broadcast(hot), "key", "left_semi").select(*plain.columns).mapInArrow(_windows(length), schema)
        plain = plain.join(F.broadcast(hot), "key", "left_anti").select(*plain.columns).unionAll(split)
    dealt = plain.repartition("dealt").sortWithinPartitions("dealt", "key", "content", "base")
    return dealt.mapInArrow(tidied(_sort_strings(length, gram)), "key bigint, content bigint, lo int, hi int, low bigint")


def _sort_strings(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            dealt = rest.column("dealt").to_numpy()
            last = int(np.searchsorted(dealt, dealt[-1])) if len(dealt) else 0
            if last:
                yield from _groups(rest.slice(0, last).combine_chunks(), length, gram)
                rest = rest.slice(last)
        if rest is not None and rest.num_rows:
            yield from _groups(rest.combine_chunks(), length, gram)

    return run


def _groups(rows: pa.Table, length: int, gram: int) -> Iterator[pa.RecordBatch]:
    names = ("dealt", "key", "content", "base", "low", "last")
    dealt, key, content, base, low, last = (rows.column(name).to_numpy() for name in names)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (dealt[1:] != dealt[:-1]) | (key[1:] != key[:-1]) | (content[1:] != content[:-1]) | (base[1:] != base[:-1])
    at = np.flatnonzero(fresh)
    low, last = np.minimum.reduceat(low, at), np.maximum.reduceat(last, at)
    strings = rows.column("string").combine_chunks().take(pa.array(at))
    strings = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    dealt, key, content, base = dealt[at], key[at], content[at], base[at]
    data, bounds = bytes_of(strings)
    mates = _may_share(data, bounds, dealt, key.view(np.uint64), length, gram)
    alone = np.flatnonzero(~mates & (low < last))
    size = (np.diff(bounds) - length + 1).astype(np.int32)
    yield _firsts(key[alone], content[alone], base[alone], base[alone] + size[alone], low[alone])
    todo = np.flatnonzero(mates)
    start = 0
    while start < len(todo):
        # whole groups only
        filled = np.cumsum(np.diff(bounds)[todo[start:]])
        stop = start + max(1, int(np.searchsorted(filled, MARK_BYTES, side="right")))
        while stop < len(todo) and dealt[todo[stop]] == dealt[todo[stop - 1]]:
            stop += 1
        at, lo, hi, least = _first_windows(data, bounds, todo[start:stop], dealt.view(np.uint64), low, length)
        some = least < last[at]
        at, lo, hi, least = at[some], lo[some], hi[some], least[some]
        yield _firsts(key[at], content[at], base[at] + lo, base[at] + hi, least)
        start = stop


def _first_windows(data, bounds, todo, dealt, low, length: int):
    """(string, lo, hi, low) runs of windows of the strings `todo` with their first document.

    Windows whose hash no other string of the group has belong to their string alone. What is
    left are stretches of windows; equal ones of a group are sorted once, and where a group
    has several, the order of their suffixes tells which windows are the same.
    """
    size = np.diff(bounds)[todo]
    begins = np.cumsum(size) - size
    data = data[np.repeat(bounds[todo] - begins, size) + np.arange(size.sum())]
    windows = size - length + 1
    owner = np.repeat(np.arange(len(todo)), windows)
    at = np.arange(len(owner)) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
    group = mix(dealt[todo])
    mark = mix(window_hashes(data, length)[at] ^ group[owner])
    order = np.argsort(mark, kind="stable")
    starts = np.flatnonzero(np.append(True, mark[order][1:] != mark[order][:-1]))
    several = np.minimum.reduceat(owner[order], starts) != np.maximum.reduceat(owner[order], starts)
    shared = np.empty(len(at), bool)
    shared[order] = np.repeat(several, np.diff(np.append(starts, len(at))))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (shared[1:] != shared[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    who, met = owner[first], shared[first]
    lo = at[first] - begins[who]
    alone = (todo[who[~met]], lo[~met], (lo + count)[~met], low[todo[who[~met]]])
    who, lo, count, begin = who[met], lo[met], count[met], at[first][met]
    if not len(who):
        return alone
    body = mix(range_hashes(data, begin, begin + count + length - 1, fold=False) ^ group[who])
    _, head, same = np.unique(body, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(head))  # different stretches in the order of their groups
    head, same = np.sort(head), place[same]
    least = np.full(len(head), _LAST)
    np.minimum.at(least, same, low[todo[who]])
    found = _judged(data, begin[head], count[head] + length - 1, dealt[todo[who[head]]], least, length)
    # every copy of a stretch takes over what was found for it
    runs_of = np.bincount(found[0], minlength=len(head))
    many = runs_of[same]
    copy = np.repeat(np.arange(len(same)), many)
    run = np.arange(len(copy)) + np.repeat((np.cumsum(runs_of) - runs_of)[same] - (np.cumsum(many) - many), many)
    copies = (todo[who[copy]], lo[copy] + found[1][run], lo[copy] + found[2][run], found[3][run])
    return tuple(np.concatenate(pair) for pair in zip(alone, copies))


def _judged(data, begin, size, group, low, length: int):
    """(stretch, lo, hi, low) of different stretches, by stretch; equal groups lie together."""
    bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    members = np.diff(np.append(bounds, len(group)))
    lone = bounds[members == 1]
    found = [(lone, np.zeros(len(lone), np.int64), size[lone] - length + 1, low[lone])]
    some, held = [], 0
    several = [(start, start + n) for start, n in zip(bounds.tolist(), members.tolist()) if n > 1]
    for last, (start, stop) in enumerate(several, 1):
        some.append(np.arange(start, stop))
        held += int(size[start:stop].sum())
        if held >= SORT_BYTES or last == len(several):
            own = np.concatenate(some)
            at, lo, hi, least = _smallest(data, begin[own], size[own], low[own], length)
            found.append((own[at], lo, hi, least))
            some, held = [], 0
    joined = [np.concatenate(parts) for parts in zip(*found)]
    order = np.argsort(joined[0], kind="stable")
    return [column[order] for column in joined]


def _firsts(key, content, lo, hi, low) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(content), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(low)],
        ["key", "content", "lo", "hi", "low"],
    )


def _may_share(data, bounds, dealt, key, length: int, gram: int) -> np.ndarray:
    """Which strings may share a window with another one of their group.

    A window that two strings share holds the string of `gram` bytes whose hash is the key,
    and half of what is left of the window lies on one side of it. So strings that agree
    with no other one on either side share nothing.
    """
    group = np.zeros(len(key), bool)
    group[1:] = dealt[1:] == dealt[:-1]
    group[:-1] |= group[1:]
    if not group.any():
        return group
    side = -(-(length - gram) // 2)
    row = np.repeat(np.arange(len(key)), np.diff(bounds))
    place = np.flatnonzero(window_hashes(data, gram) == key[row[: len(data) - gram + 1]])
    place = place[group[row[place]] & (place + gram <= bounds[row[place] + 1])]
    wide = window_hashes(data, gram + side) if len(data) >= gram + side else np.zeros(0, np.uint64)
    right = place[place + gram + side <= bounds[row[place] + 1]]
    left = place[place - side >= bounds[row[place]]] - side
    at = np.concatenate([right, left])
    mark = mix(wide[at] ^ mix(dealt[row[at]].view(np.uint64)) ^ np.repeat(np.array([1, 2], np.uint64), [len(right), len(left)]))
    order = np.lexsort((row[at], mark))
    mark, owner = mark[order], row[at][order]
    starts = np.flatnonzero(np.append(True, mark[1:] != mark[:-1])) if len(mark) else np.zeros(0, int)
    found = np.zeros(len(key), bool)
    if len(mark):
        several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
        found[owner[np.repeat(several, np.diff(np.append(starts, len(mark))))]] = True
    return found


def _smallest(data, begin, sizes, low, length: int):
    """(string, lo, hi, low) runs of windows of the strings at `begin` with their first document."""
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(ends[-1], np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    source = np.repeat(begin - (ends - sizes - 1), sizes) + np.flatnonzero(inside)
    symbols[inside] = data[source].astype(np.int64) + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = np.arange(len(symbols)) + length <= (ends - 1)[owner]
    order = suffix_array(symbols)
    order = order[whole[order]]
    views = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.int16), length)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 20_000):
        stop = min(at + 20_000, len(order))
        same[at:stop] = (views[order[at:stop]] == views[order[at - 1 : stop - 1]]).all(axis=1)
    starts = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(low[owner[order]], starts), np.diff(np.append(starts, len(order))))
    place = np.argsort(order)
    order, least = order[place], least[place]
    own = owner[order]
    begin = np.ones(len(order), bool)
    begin[1:] = (own[1:] != own[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(begin)
    count = np.diff(np.append(first, len(order)))
    lo = order[first] - (ends - sizes - 1)[own[first]]
    return own[first], lo, lo + count, least[first]


def repeated_spans(documents: DataFrame, cut, doc="doc_id", text="text", length: int = LENGTH, gram: int = GRAM,
                   hot_strings: int = HOT_STRINGS) -> DataFrame:
    """(doc, body, spans): per document the byte ranges of repeated windows, as they come."""
    bodies = cut(texts_of(documents, doc, text))
    heads = cut(bodies.groupBy("body", "sum").agg(F.min("doc").alias("head")))
    shared = cut(shared_keys(window_keys(documents, doc, text, length, gram)))
    found = cut(occurrences(documents, heads.select(F.col("head").alias("doc"), "body"), shared, doc, text, length, gram))
    free(shared)
    strings = found.filter("string is not null").select("key", "content", F.col("doc").alias("low"), "last", "string")
    # written, so that the dealt strings are gone before the occurrences are dealt
    hot = cut(hot_keys(strings, hot_strings))
    firsts = cut(first_documents(strings, length, gram, hot_strings, hot))
    free(hot)
    earlier = found.drop("string", "last").join(firsts, ["key", "content"]).filter("low < doc")
    spans = earlier.select("doc", "body", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + (length - 1)).alias("hi"))
    # a copy of an earlier text is covered altogether
    copies = bodies.join(heads, ["body", "sum"]).filter((F.col("head") < F.col("doc")) & (F.col("bytes") >= length))
    whole = copies.select("doc", "body", F.lit(0).cast("long").alias("lo"), F.col("bytes").alias("hi"))
    # dealt as plain rows: lists begun before they are dealt hold a span or two and take far more room
    dealt = spans.unionAll(whole).repartition("doc", "body")
    spans = cut(dealt.groupBy("doc", "body").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    free(bodies, heads, found, firsts)
    return spans


def without_repeats(documents: DataFrame, cut, doc="doc_id", text="text", length: int = LENGTH, gram: int = GRAM,
                    hot_strings: int = HOT_STRINGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With `keep`, also those columns of the input and `kept_text`, the text that is left; it
    keeps characters of which only some bytes are covered. `cut` writes a frame that is read
    again.
    """
    spans = repeated_spans(documents, cut, doc, text, length, gram, hot_strings)
    passed = [F.col(name).alias(f"_{name}") for name in keep]
    rows = documents.select(F.col(doc).alias("doc_id"), _order(doc).alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"), *passed)
    joined = rows.join(spans, ["doc", "body"], "left").select(
        "doc_id", "text", F.col("spans.lo").alias("lo"), F.col("spans.hi").alias("hi"), *[f"_{name}" for name in keep]
    )
    schema = f"doc_id {documents.schema[doc].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if keep:
        schema += ", kept_text string, " + ", ".join(f"`{name}` {documents.schema[name].dataType.simpleString()}" for name in keep)
    return joined.mapInArrow(tidied(lambda batches: _cut_out(batches, keep)), schema)


def _cut_out(batches: Iterator[pa.RecordBatch], keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text", *keep] * bool(keep)
    for batch in batches:
        for part in slices(batch, "text"):
            data, bounds = bytes_of(part.column("text"))
            removed, count, digests, texts = [], [], [], []
            for at in range(part.num_rows):
                raw = data[bounds[at] : bounds[at + 1]]
                covered = np.zeros(len(raw), bool)
                lo, hi = part.column("lo")[at], part.column("hi")[at]
                if lo.is_valid:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, lo.values.to_numpy(), 1)
                    np.add.at(edge, hi.values.to_numpy(), -1)
                    covered = np.cumsum(edge)[:-1] > 0
                removed.append(int(covered.sum()))
                count.append(int(covered[:1].sum()) + int((covered[1:] & ~covered[:-1]).sum()))
                digests.append(hashlib.sha256(raw[~covered].tobytes()).hexdigest())
                if keep:
                    texts.append(_whole_characters(raw, covered) if part.column("text")[at].is_valid else None)
            arrays = [
                part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string()),
            ]
            if keep:
                arrays += [pa.array(texts, pa.string()), *(part.column(f"_{name}") for name in keep)]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _whole_characters(raw: np.ndarray, covered: np.ndarray) -> str:
    if covered.any():
        first = (raw & 0xC0) != 0x80
        gone = np.logical_and.reduceat(covered, np.flatnonzero(first))
        raw = raw[~gone[np.cumsum(first) - 1]]
    return raw.tobytes().decode()
