"""Runs of words against comparing all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filescape.llm import queries, runs

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    """All maximal repetitions of at least `least` words and two periods, by every period."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        start = 0
        while start < len(words) - period:
            end = start
            while end < len(words) - period and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if length >= max(least, 2 * period):
                found.setdefault((start, length), period)
            start = max(end, start + 1)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def line_of(words):
    kinds = sorted(set(words))
    return np.array([0, *(kinds.index(w) + 1 for w in words), 0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=20), st.sampled_from([4, 12]))
def test_runs_of(root, times, tail, least):
    words = tail[::-1] + root * times + tail
    found = [(start - 1, length, period) for start, length, period in runs.runs_of(line_of(words), least).tolist()]
    assert found == plain_runs(words, least)


def test_groups_hold_lyndon_words():
    """Every place's length is that of the longest Lyndon word there, in both orders."""

    def is_lyndon(word):
        return all(word < word[i:] + word[:i] for i in range(1, len(word)))

    rng = np.random.default_rng(3)
    for _ in range(60):
        symbols = np.concatenate([[0], np.unique(rng.integers(1, 4, 24), return_inverse=True)[1] + 1, [0]])
        for line in (symbols, np.where(symbols > 0, symbols.max() + 1 - symbols, 0)):
            length, group = runs.lyndon_groups(line)
            words = line.tolist()[1:-1]
            longest = [max(n for n in range(1, len(words) - i + 1) if is_lyndon(words[i : i + n])) for i in range(len(words))]
            assert length[1:-1].tolist() == longest
            named = {}
            for i, n in enumerate(longest):
                assert named.setdefault(group[i + 1], words[i : i + n]) == words[i : i + n]
            assert len(named) == len({tuple(w) for w in named.values()})


def found_in(spark, texts, rows):
    return {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(texts(rows)).collect()}


def test_texts(spark, texts):
    rng = np.random.default_rng(8)
    rows = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "a " * 11, 5: "a\t" * 12, 6: "A a " * 6, 7: "é ü " * 40 + "\n end"}
    for i in range(10, 90):
        root = [f"w{k}" for k in rng.integers(0, 6, rng.integers(1, 30))]
        words = [f"w{k}" for k in rng.integers(0, 40, rng.integers(0, 60))] + root * rng.integers(1, 5) + root[: rng.integers(0, len(root))]
        rows[i] = (" " * rng.integers(0, 2)) + "  ".join(words)
    found = found_in(spark, texts, rows)
    assert set(found) == set(rows)
    for doc, text in rows.items():
        words = _WORD.findall(text or "")
        assert found[doc] == (plain_runs(words), collapse(words, plain_runs(words)))


def test_long_text(spark, texts):
    """Over 40 MB in one text, with runs far apart and one word longer than a block."""
    root = [f"x{i}" for i in range(50_000)]
    filler = "".join(f"f{i} " for i in range(4_000_000))
    words = [*root, *root, "y" * (3 << 20), *filler.split(), *["z"] * 20, "y" * (3 << 20)]
    (runs_found, left) = found_in(spark, texts, {1: " ".join(words)})[1]
    assert runs_found == [(0, 100_000, 50_000), (100_001 + 4_000_000, 20, 1)]
    assert hashlib.sha256(left.encode()).digest() == hashlib.sha256(collapse(words, runs_found).encode()).digest()


def test_repeated_ids_and_empty_table(spark, texts):
    same = runs.find_runs(texts([(1, "a " * 20), (1, "a " * 20), (None, "b"), (None, None)])).collect()
    assert sorted(((r.doc_id or -1, len(r.runs), r.collapsed) for r in same)) == [(-1, 0, ""), (-1, 0, "b"), (1, 1, "a"), (1, 1, "a")]
    assert runs.run_facts(runs.find_runs(texts({}))).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(texts({}), least=5)


def test_facts(spark, texts):
    rows = {1: "a " * 20 + "q " + "b c " * 10, 2: None, 3: "q " + "b c " * 10 + "a " * 20}
    found = {r.doc_id: r for r in runs.run_facts(runs.find_runs(texts(rows))).collect()}
    assert tuple(found[1])[1:6] == (2, 0, 20, 1, 20_000)
    assert found[1].runs_sha256 == hashlib.sha256(b"0,20,1\n21,20,2\n").hexdigest()
    assert found[1].collapsed_sha256 == hashlib.sha256(b"a q b c").hexdigest()
    assert tuple(found[2])[1:6] == (0, None, None, None, None)
    assert found[2].runs_sha256 == found[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert tuple(found[3])[1:6] == (2, 1, 20, 2, 10_000)


def test_planted(spark, texts):
    rows = {i: " ".join(f"w{k}" for k in range(i % 60)) for i in range(400)}
    planted = {r.doc_id: r.text for r in runs.plant_periods(texts(rows), queries.language.remainder("doc_id", 1 << 32)).collect()}
    chosen = 0
    for doc, text in rows.items():
        number, words = zlib.crc32(str(doc).encode()), text.split()
        if number % 10 == 0 and words:
            g, n = number // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
            chosen += 1
        assert planted[doc] == text
    assert chosen > 20
