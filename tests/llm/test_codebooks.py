"""Vector codes against plain loops over whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from filescape.llm import codebooks

SCHEMA = "vec_id bigint, embedding array<float>, label int, `row` string, place int, size int, part int"


def plain(rows, entries=256, rounds=4):
    """Codes by comparing every part with every entry; rows of (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in np.array(v, np.float32).tolist()], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = -(-max(len(v) for _, v, _ in kept) // 4)
    cut = lambda v: [(v + [0] * (4 * width - len(v)))[p * width : (p + 1) * width] for p in range(4)]
    line = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    books = [[cut(v)[p] for _, v, _ in line[:entries]] for p in range(4)]

    def near(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(column) // len(members[e]) for column in zip(*members[e])] if members[e] else entry for e, entry in enumerate(books[p])]
    out, total = [], defaultdict(int)
    for i, v, label in kept:
        found = [near(piece, book) for piece, book in zip(cut(v), books)]
        error = sum(d for d, _ in found)
        total[label] += error
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), error))
    return sorted(((*row, total[row[1]]) for row in out), key=str), books


def run(spark, cut, rows, **options):
    df = spark.createDataFrame([(i, v, label, "r", 1, 2, 3) for i, v, label in rows], SCHEMA)
    found, books = codebooks.encode_vectors(df, cut, **options)
    return sorted(map(tuple, found.select("vec_id", "label", "code", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize("block", [256, 7])
def test_against_all_entries(spark, cut, block):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 12))
    rows = [(int(i), (centers[rng.integers(30)] + rng.normal(size=12) * rng.choice([0, 0.05, 1])).tolist(), int(rng.integers(4)) or None) for i in rng.permutation(400)]
    expected, books = plain(rows, 40)
    found, told = run(spark, cut, rows, entries=40, block=block)
    assert found == expected and told.tolist() == books
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    assert codebooks.books_digest(told) == digest


def test_odd_vectors(spark, cut):
    rows = [(1, [0.5] * 8, 1), (2, None, 1), (3, [1.0, None] * 4, 1), (4, [math.nan] * 8, 2), (5, [math.inf] * 8, 2), (6, [], None), (7, [-0.0001], None),
            (8, [0.25] * 9, 1), (None, [0.5] * 8, 2), (1, [0.5] * 8, 1), (1, [0.25] * 8, 3), (9, [0.0] * 8, None)]
    found, books = run(spark, cut, rows)
    expected, plain_books = plain(rows)
    assert found == expected and books.tolist() == plain_books and len(found) == 8
    assert run(spark, cut, [])[0] == [] and run(spark, cut, [(1, None, 1)])[0] == []
    assert run(spark, cut, [(1, [], 1), (2, [], None)])[0] == [(1, 1, "00000000", 0, 0), (2, None, "00000000", 0, 0)]


def test_ties_and_copies(spark, cut):
    """Many copies of one vector, entries that repeat, and points half way between two."""
    rows = [(i, [0.0] * 8, 1) for i in range(300)] + [(300 + i, [(i % 3 - 1) / 1024] * 8, 2) for i in range(60)]
    assert run(spark, cut, rows, block=16)[0] == plain(rows)[0]
    few = [(0, [2 / 1024] * 4, 0), (1, [-2 / 1024] * 4, 0), *((i, [0.0] * 4, 0) for i in range(2, 40))]
    assert run(spark, cut, few, entries=2, rounds=0)[0] == plain(few, 2, 0)[0]


def test_very_large_numbers(spark, cut):
    """Whole numbers that doubles cannot square exactly, and those beyond the bound."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * 50_000).tolist(), 0) for i in range(60)]
    assert run(spark, cut, rows, entries=20)[0] == plain(rows, 20)[0]
    found, books = run(spark, cut, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], entries=1, rounds=0)
    bound = math.isqrt((1 << 58) // 2)
    assert books.max() == bound and [row[3] for row in found] == [0, 8 * (2 * bound) ** 2]


def test_short_lists_hold_the_nearest():
    rng = np.random.default_rng(9)
    for _ in range(50):
        pieces = rng.integers(-50, 50, (20, 3))
        entries = rng.integers(-60, 60, (15, 3))
        listed = codebooks.short_lists(pieces.min(axis=0)[None], pieces.max(axis=0)[None], entries)[0]
        distance = ((pieces[:, None] - entries) ** 2).sum(axis=2)
        assert listed[np.unique(np.nonzero(distance == distance.min(axis=1, keepdims=True))[1])].all()
        best, found = codebooks.nearest(pieces, entries)
        assert (best == distance.argmin(axis=1)).all() and (found == distance.min(axis=1)).all()
