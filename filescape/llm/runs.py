"""Periodic runs of words, by Lyndon arrays under both orders of the words.

Phase one of suffix sorting by groups of Lyndon prefixes gives, without any sorting of
suffixes, the longest Lyndon word at every place, and places of the same Lyndon word share a
group. It is run once with the words in one order and once in the opposite order. Every run
has a Lyndon root in one of them: places of a group that follow each other at the length of
their Lyndon word are repetitions of one root, and the longest common extensions to both
sides give the run. Roots whose run is shorter than asked for are passed over.

Only stretches that can hold a run are grouped. In a run of at least 12 words, two periods
included, each word is part of a 6-gram that occurs twice in the run, so what is not covered
by a 6-gram occurring twice in its stretch of covered words belongs to none. This rules
words out only; runs are found by the groups alone.

Words are runs of bytes other than space and \\t..\\r, compared by 64-bit hashes. Case
counts. A null text, and one without words, has no runs and nothing left. Rows with equal or
null ids are rows of their own, an empty table gives no rows, and other columns are not
looked at. A text is worked on whole in one task: where all its words are covered this takes
about 150 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescape.llm.tables import lists, slices
from filescape.llm.words import mix, range_hashes, spans

LEAST_WORDS = 12
_STEPS, _ROUNDS, _WORDS_AT_ONCE = 64, 4, 1 << 17


def lyndon_groups(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, group) of the longest Lyndon word at every place of `symbols`.

    Symbols are small numbers; 0 is a border that no word crosses and that has no group, and
    the first symbol is one. Groups are finished from the highest down: each place of a
    finished group lets the nearest place to its left in a lower group grow by the group's
    word, and places that grow alike get a group of their own right above their old one.
    """
    order = np.argsort(symbols, kind="stable")
    members: list = [part.tolist() for part in np.split(order, np.cumsum(np.bincount(symbols))[:-1])]
    where, live = symbols.tolist(), [len(part) for part in members]
    size = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    before = list(range(-1, len(symbols) - 1))
    done = bytearray(len(symbols))

    def grow(moved: list[int], old: int, more: int) -> None:
        if live[old] == len(moved):
            size[old] += more
            return
        new, higher = len(size), above[old]
        size.append(size[old] + more)
        members.append(moved)
        live.append(len(moved))
        below.append(old)
        above.append(higher)
        above[old] = new
        if higher < len(below):
            below[higher] = new
        live[old] -= len(moved)
        for place in moved:
            where[place] = new

    group = last = len(members) - 1
    above[last] = 1 << 62
    while group > 0:
        own = members[group]
        members[group] = None
        if live[group] < len(own):
            own = [place for place in own if where[place] == group]
        if len(own) == 1:
            place = own[0]
            done[place] = 1
            at = before[place]
            while done[at]:
                at = before[at]
            before[place] = at
            old = where[at]
            if old:
                if live[old] == 1:
                    size[old] += size[group]
                else:
                    grow([at], old, size[group])
        elif own:
            for place in own:
                done[place] = 1
            times: dict[int, int] = {}
            for place in own:
                at = before[place]
                while done[at]:
                    at = before[at]
                before[place] = at
                if where[at]:
                    times[at] = times.get(at, 0) + 1
            alike: dict[tuple[int, int], list[int]] = {}
            for at, often in times.items():
                alike.setdefault((-often, where[at]), []).append(at)
            for (often, old), moved in sorted(alike.items()):
                grow(moved, old, -often * size[group])
        group = below[group]
    found = np.array(where)
    return np.array(size)[found], found


def _chains(length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, length) of repetitions of one Lyndon word, one after the other."""
    place = np.flatnonzero(group)
    step, own = length[place], group[place]
    far = len(group) - 1
    begins = group[np.maximum(place - step, 0)] != own
    ends = group[np.minimum(place + step, far)] != own
    first, last = place[begins], place[ends]

    def in_line(some: np.ndarray) -> np.ndarray:
        return some[np.lexsort((some, some % length[some], group[some]))]

    first, last = in_line(first), in_line(last)
    return first, last, length[first]


def _extension(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, way: int) -> np.ndarray:
    """How far the words from `low` and `high` on agree, forward or backward. Borders agree
    with no word, and a run's root ends each comparison in time."""
    agreed = np.zeros(len(low), np.int64)
    active = np.arange(len(low))
    for step in range(_STEPS):
        if not len(active):
            return agreed
        active = active[symbols[low[active] + way * step] == symbols[high[active] + way * step]]
        agreed[active] = step + 1
    for one in active.tolist():
        a, b, run = int(low[one]) + way * _STEPS, int(high[one]) + way * _STEPS, _STEPS
        while True:
            left, right = (symbols[a : a + run], symbols[b : b + run]) if way > 0 else (symbols[max(a - run + 1, 0) : a + 1][::-1], symbols[max(b - run + 1, 0) : b + 1][::-1])
            both = min(len(left), len(right))
            differ = np.flatnonzero(left[:both] != right[:both])
            if len(differ) or both < run:
                agreed[one] += int(differ[0]) if len(differ) else both
                break
            agreed[one] += run
            a, b, run = a + way * run, b + way * run, 2 * run
    return agreed


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least `least` symbols and two periods,
    by start and period. The symbols are as in `lyndon_groups`, with a border at both ends."""
    found = []
    top = symbols.max(initial=0) + 1
    for line in (symbols, np.where(symbols > 0, top - symbols, 0)):
        first, last, period = _chains(*lyndon_groups(line))
        known = last + period - first
        some = np.flatnonzero(known + 2 * (period - 1) >= np.maximum(least, 2 * period))
        first, last, period, known = first[some], last[some], period[some], known[some]
        ahead = _extension(symbols, last, last + period, 1)
        back = _extension(symbols, first - 1, first - 1 + period, -1)
        length = known + ahead + back
        good = length >= np.maximum(least, 2 * period)
        found.append(np.stack([first - back, length, period], axis=1)[good])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _covered(keys: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches covered by runs of `width` words that occur twice in
    their stretch; `owner` numbers the texts of the words. A stretch is looked at again while
    words fall away, a few times at most: what is left too much costs time only."""
    none = np.zeros(0, np.int64)
    if len(keys) < width:
        return none, none
    grams = np.zeros(len(keys) - width + 1, np.uint64)
    for step in range(width):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + keys[step : step + len(grams)]
    stretch, at, left = owner, np.arange(len(grams)), len(keys)
    for _ in range(_ROUNDS):
        at = at[(stretch[at] == stretch[at + width - 1]) & (stretch[at] >= 0)]
        own = mix(grams[at] ^ mix(stretch[at].astype(np.uint64)))
        line = np.sort(own)
        twice = line[1:][line[1:] == line[:-1]]
        if not len(twice):
            return none, none
        at = at[twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own]
        depth = np.bincount(at, minlength=len(keys) + 1) - np.bincount(at + width, minlength=len(keys) + 1)
        covered = np.cumsum(depth[:-1]) > 0
        fresh = covered.copy()
        fresh[1:] &= ~covered[:-1] | (stretch[1:] != stretch[:-1])
        stretch = np.where(covered, np.cumsum(fresh) - 1, -1)
        before, left = left, int(covered.sum())
        if left == before:
            break
    starts = np.flatnonzero(fresh)
    return starts, starts + np.bincount(stretch[covered])


def _text_runs(keys: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Rows (text, start, length, period) of the runs of all texts, from the words' hashes."""
    width = least // 2
    starts, ends = _covered(keys, np.repeat(np.arange(len(counts)), counts), width)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    sizes = ends - starts
    line = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    seats = np.cumsum(sizes + 1) - sizes  # behind a border each
    source = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    target = np.repeat(seats - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    line[target] = np.unique(keys[source], return_inverse=True)[1] + 1
    found = runs_of(line, least)
    which = np.searchsorted(seats, found[:, 0], side="right") - 1
    place = found[:, 0] - seats[which] + starts[which]
    begin = np.cumsum(counts) - counts
    text = np.searchsorted(begin + counts, place, side="right")
    return np.stack([text, place - begin[text], found[:, 1], found[:, 2]], axis=1)


def _left(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray | None) -> bytes:
    """The words of a text that are not gone, joined by single blanks."""
    parts = []
    for low in range(0, len(starts), _WORDS_AT_ONCE):
        high = min(low + _WORDS_AT_ONCE, len(starts))
        words = data[starts[low] : ends[high - 1]].tobytes().split()
        if gone is not None:
            words = list(compress(words, ~gone[low:high]))
        if words:
            parts.append(b" ".join(words))
    return b" ".join(parts)


def find_runs(documents: DataFrame, doc="doc_id", text="text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, runs, collapsed) per row: the runs of at least `least` words as an array of
    (start, length, period) by start and period, and the text without the words that lie in
    a run behind its first period. `least` is even."""
    if least < 4 or least % 2:
        raise ValueError("least must be an even number of at least 4 words")
    kind = documents.schema[doc].dataType.simpleString()
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _collapsed(part, least)

    return rows.mapInArrow(run, schema)


def _collapsed(part: pa.RecordBatch, least: int) -> pa.RecordBatch:
    data, starts, ends, counts = spans(part.column("text"))
    found = _text_runs(range_hashes(data, starts, ends, fold=False), counts, least)
    each = np.bincount(found[:, 0], minlength=len(counts))
    begin, first = np.cumsum(counts) - counts, np.cumsum(each) - each
    left = []
    for row in range(len(counts)):
        low, high = begin[row], begin[row] + counts[row]
        gone = None
        if each[row]:
            own = found[first[row] : first[row] + each[row]]
            depth = np.zeros(counts[row] + 1, np.int64)
            np.add.at(depth, own[:, 1] + own[:, 3], 1)
            np.add.at(depth, own[:, 1] + own[:, 2], -1)
            gone = np.cumsum(depth[:-1]) > 0
        left.append(_left(data, starts[low:high], ends[low:high], gone))
    rows = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
    shell = lists(np.zeros(len(found), np.int64), each)
    runs = pa.ListArray.from_arrays(shell.offsets, rows)
    return pa.RecordBatch.from_arrays([part.column("doc_id"), runs, pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def run_facts(found: DataFrame) -> DataFrame:
    """Numbers and digests of the rows of `find_runs`: n_runs, the longest run (smallest start,
    then period), SHA-256 of the list of runs and of the text that is left."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("below"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_longest.start").alias("start"),
        (-F.col("_longest.below")).alias("length"),
        F.col("_longest.period").alias("period"),
        F.expr("(1000 * -_longest.below) div _longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def plant_periods(documents: DataFrame, number: Column, doc="doc_id", text="text") -> DataFrame:
    """(doc_id, text) with a repetition in the texts whose `number` is divisible by 10.

    With g the number without its last digit and n words, the words from a = g % n on repeat
    the p = 1 + (n - a) div (3 + g % 8) words from there. Such texts are joined anew by
    single blanks, the others stay as they are; a null number counts as not divisible.
    """
    kind = documents.schema[doc].dataType.simpleString()
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), number.cast("long").alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                chosen = [i for i, n in enumerate(part.column("number").to_pylist()) if n is not None and n % 10 == 0]
                if chosen:
                    numbers = part.column("number").to_pylist()
                    whole = texts.to_pylist()
                    for row in chosen:
                        whole[row] = _repeated(whole[row], numbers[row] // 10)
                    texts = pa.array(whole, pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), texts], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def _repeated(text: str | None, g: int) -> str | None:
    words = (text or "").encode().split()
    if not words:
        return text
    at = g % len(words)
    period = 1 + (len(words) - at) // (3 + g % 8)
    times = -(-(len(words) - at) // period)
    return b" ".join(words[:at] + (words[at : at + period] * times)[: len(words) - at]).decode()
