"""The gram index and the texts it takes from patterns."""

import random

import pytest

from filescape.functions.regex import required_literals
from filescape.operators import grams, grep
from filescape.sources import catalog, content


@pytest.mark.parametrize(
    ("pattern", "ignore_case", "expected"),
    [
        ("abc", False, [["abc"]]),
        ("abc+d", False, [["abc", "d"]]),
        ("abc*d", False, [["ab", "d"]]),
        ("abc{0,3}d", False, [["ab", "d"]]),
        ("abc{2}d", False, [["abc", "d"]]),
        ("ab|cd", False, [["ab"], ["cd"]]),
        ("x(ab|cd)y", False, [["x", "y"]]),
        ("x(ab(cd)?ef)+y", False, [["x", "ab", "ef", "y"]]),
        ("x(ab)?y", False, [["x", "y"]]),
        ("x(ab)*?y", False, [["x", "y"]]),
        (r"a\.b\dc[^x]d.e", False, [["a.b", "c", "d", "e"]]),
        (r"\Qa.b\E*c", False, [["a.", "c"]]),
        (r"^a$\x41b", False, [["a", "b"]]),
        ("caf\u00e9s", False, [["caf", "s"]]),
        ("mask", True, [["ma"]]),
        ("a(?i:sb)c", False, [["a", "b", "c"]]),
        ("a{b}", False, [["a{b}"]]),
        ("", False, [[]]),
    ],
)
def test_literals(pattern, ignore_case, expected):
    assert required_literals(pattern, ignore_case) == expected


def test_fixed_literals():
    assert required_literals("a.b*\u00e9c", fixed=True) == [["a.b*", "c"]]


def test_grams_over_blocks(monkeypatch):
    monkeypatch.setattr(grams, "_BLOCK", 5)
    data = bytes(random.Random(1).choices(b"abAB\n", k=99))
    expected = {int.from_bytes(data.lower()[i : i + 3]) for i in range(97)}
    assert set(grams.distinct_grams(data).tolist()) == expected
    assert len(grams.distinct_grams(b"ab")) == 0


def made_files():
    rng = random.Random(8)
    words = ["mole", "MOLE", "heron", "Heron's", "owl", "caf\u00e9", "\u212aelp", "kelp", "\u017fand", "sand", ""]
    files = {f"d{i % 4}/f{i}.txt": "\n".join(" ".join(rng.choices(words, k=rng.randrange(3))) for _ in range(rng.randrange(6))) for i in range(60)}
    return files | {"d0/empty.txt": "", "d0/two.txt": "ow", "d0/long.txt": "x" * 5000 + "heron" + "y" * 70}


PATTERNS = [
    ("heron", False, False), ("heron", True, False), ("kelp", True, False), ("sand|owl", True, False), ("mole|h?eron", False, False),
    ("mo(le)+", False, False), ("Heron's", False, True), ("x+her", False, False), ("[hH]eron", False, False), ("nowhere", False, False),
]


@pytest.mark.parametrize(("pattern", "ignore_case", "fixed"), PATTERNS)
def test_table_search(spark, pattern, ignore_case, fixed):
    rows = [(f"/{path}", text) for path, text in made_files().items()] + [("/none.txt", None)]
    named = [(path, path.rsplit("/", 1)[-1], text) for path, text in rows]
    files = spark.createDataFrame(named, "path string, name string, content string")
    index = grams.gram_index(files)
    expected = grep.grep_files(files, pattern, ignore_case, fixed).collect()
    assert grams.grep_indexed(files, index, pattern, ignore_case, fixed).collect() == expected
    assert grams.grep_indexed(files, index, pattern, ignore_case, fixed, broadcast_bytes=-1).collect() == expected
    matched = {row["path"] for row in expected}
    candidates = grams.gram_candidates(index, pattern, ignore_case, fixed)
    if candidates is not None:
        found = [row["path"] for row in candidates.collect()]
        assert len(found) == len(set(found)) and matched <= set(found)
        assert len(found) < 0.7 * len(rows)


@pytest.mark.parametrize("step", [2, 50, 1 << 20])
def test_live_search_reads_candidates_only(spark, make_tree, tmp_path, step):
    root = make_tree(made_files())
    files = catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))
    path = str(tmp_path / "grams")
    grams.save_grams(content.catalog_grams(files, range_bytes=step), path)
    index = spark.read.parquet(path)
    for pattern, ignore_case, fixed in PATTERNS[:3]:
        expected = content.grep_catalog(files, pattern, ignore_case, fixed, range_bytes=step).collect()
        assert content.grep_catalog(files, pattern, ignore_case, fixed, range_bytes=step, grams=index).collect() == expected
    # a file whose content changed after it was indexed is not opened
    with open(f"{root}/d0/two.txt", "w") as stream:
        stream.write("heron")
    assert f"{root}/d0/two.txt" not in {r["path"] for r in content.grep_catalog(files, "heron", grams=index).collect()}


def test_the_index_is_stored_as_numbers(spark, tmp_path):
    """A posting is a number in a segment, and nothing is shuffled."""
    files = spark.createDataFrame([(f"/{path}", path, text) for path, text in made_files().items()], "path string, name string, content string")
    index = grams.gram_index(files)
    assert "Exchange" not in index.sortWithinPartitions("gram")._jdf.queryExecution().executedPlan().toString()
    grams.save_grams(index, str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.where("(gram < 0) != (paths is not null)").isEmpty()
    held = {r[0] for r in grams.gram_candidates(stored, "heron").collect()}
    assert held == {f"/{path}" for path, text in made_files().items() if all(g in text.lower() for g in ("her", "ero", "ron"))}
