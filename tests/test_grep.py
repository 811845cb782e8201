import pytest

from filescape.operators import grep
from filescape.sources import catalog, content

MIB = 1024 * 1024

LINE_CASES = {
    "crlf.txt": b"one\r\ntwo\r\n\r\n",
    "open.txt": b"one\ntwo",
    "empty.txt": b"",
    "blank.txt": b"\n",
    "blanks.txt": b"\n\nx\n\n",
    "cr.txt": b"a\rb\r\r\n",
    "nul_later.txt": b"pearl\nx\0y pearl\n",
    "nul_first.txt": b"a\0b pearl\npearl\n",
    "utf8.txt": "é pearl\n".encode(),
    "bad_utf8.txt": b"\xff\xfe pearl\n",
    "long.txt": b"pearl 1\n" + b"x" * MIB + b"\npearl 2\n",
    "fits.txt": b"pearl 1\n" + b"x" * (MIB - 1) + b"\npearl 2\n",
    "long_end.txt": b"pearl 1\n" + b"x" * MIB,
    "long_first.txt": b"\0" + b"x" * MIB + b"\npearl 2\n",
}


def expected_lines(data, cap=None):
    """The line rules written out plainly."""
    out = []
    pieces = data.split(b"\n")
    last = pieces.pop()
    pieces = [(p, True) for p in pieces] + ([(last, False)] if last else [])
    for number, (piece, _) in enumerate(pieces, start=1):
        if cap and len(piece) >= cap:
            break
        if number == 1 and b"\0" in piece:
            return []
        out.append((number, piece[:-1] if piece.endswith(b"\r") else piece))
    return out


def table_of(spark, cases):
    rows = [(f"/t/{n}", n, len(c), c) for n, c in cases.items()]
    return spark.createDataFrame(
        rows, "path string, name string, size long, raw binary"
    ).selectExpr("path", "name", "size", "cast(raw as string) as content")


@pytest.mark.parametrize("cap", [None, MIB])
def test_lines_of_a_table(spark, cap):
    cases = {n: c for n, c in LINE_CASES.items() if n != "bad_utf8.txt"}
    files = table_of(spark, cases)
    found = {}
    for row in grep.split_lines(grep.text_only(files), max_line_bytes=cap).collect():
        found.setdefault(row["path"][3:], []).append((row["line"], row["text"].encode()))
    for name, data in cases.items():
        assert sorted(found.get(name, [])) == expected_lines(data, cap), name
    cut_off = {r["path"][3:] for r in grep.grep_cut_off(files, cap).collect()}
    assert cut_off == ({"long.txt", "long_end.txt", "long_first.txt"} if cap else set())


@pytest.mark.parametrize("cap", [None, MIB])
def test_lines_of_live_files(spark, make_tree, cap):
    root = make_tree(LINE_CASES)
    files = catalog.catalog_files(catalog.file_catalog(spark, root))
    found = {}
    for row in content.file_lines(files, cap).collect():
        found.setdefault(row["path"].rsplit("/", 1)[-1], []).append((row["line"], row["text"]))
    for name, data in LINE_CASES.items():
        plain = [(n, t.decode("utf-8", "replace")) for n, t in expected_lines(data, cap)]
        assert sorted(found.get(name, [])) == plain, name


def test_match_after_a_long_line(spark, make_tree):
    data = b"x" * (2 * MIB) + b"\nblack pearl\n"
    assert [r["line"] for r in grep.grep_files(table_of(spark, {"deep.txt": data}), "p[e]arl").collect()] == [2]
    files = catalog.catalog_files(catalog.file_catalog(spark, make_tree({"deep.txt": data})))
    assert [r["line"] for r in content.grep_catalog(files, "p[e]arl").collect()] == [2]


def test_match_and_binary(spark, make_tree):
    root = make_tree(
        {
            "ship/log.md": "calm\nwind NW 7, reef\n\ncalm\n",
            "ship/crew.md": "cook\nmate\n",
            "ship/chart.bin": b"wind\x00rose\nwind S 2\n",
        }
    )
    files = catalog.catalog_files(catalog.file_catalog(spark, root))
    expected = [(f"{root}/ship/log.md", 2, "wind NW 7, reef")]
    assert [tuple(r) for r in content.grep_catalog(files, r"wind \w+ \d", root=root).collect()] == expected
    read = content.file_content(files).where("number = 0").selectExpr("path", "cast(content as string) as content")
    table = files.select("path", "name", "size").join(read, "path")
    assert [tuple(r) for r in grep.grep_files(table, r"wind \w+ \d", root=root).collect()] == expected


def test_literal_ignore_case(spark):
    files = table_of(spark, {"p.txt": b"cost [EUR] 5\ncost eur 5\n"})
    found = grep.grep_files(files, "[eur]", ignore_case=True, fixed=True).collect()
    assert [r["line"] for r in found] == [1]
    assert grep.grep_files(files, "[eur]", fixed=True).count() == 0
    assert grep.grep_files(files, "5\ncost", fixed=True).count() == 0


def test_size_limit(spark):
    files = table_of(spark, {"wide.txt": b"oyster, pearl\n", "s": b"o"})
    assert grep.grep_files(files, "pearl", max_bytes=5).count() == 0
    assert [r["path"] for r in grep.grep_too_large(files, 5).collect()] == ["/t/wide.txt"]
    assert grep.grep_too_large(files).count() == 0 and grep.grep_files(files, "pearl").count() == 1
    matches = grep.grep_files(files, "o", max_bytes=5)
    assert tuple(grep.grep_counts(matches, grep.grep_too_large(files, 5)).collect()[0]) == (1, 1)


def test_order_and_extensions(spark):
    files = table_of(spark, {"b.go": b"x\nx\n", "A.go": b"x\n", "c.py": b"x\n"})
    found = grep.grep_files(files, "x", exts="go", root="/t").collect()
    assert [(r["path"], r["line"]) for r in found] == [("/t/A.go", 1), ("/t/b.go", 1), ("/t/b.go", 2)]


def test_unreadable_files_are_passed_over(spark, make_tree):
    root = make_tree({"a.txt": "pearl\n"})
    files = spark.createDataFrame(
        [(f"{root}/a.txt", "a.txt", 6), (f"{root}/gone.txt", "gone.txt", 6)],
        "path string, name string, size long",
    )
    assert content.grep_catalog(files, "pearl").count() == 1


def test_bad_pattern(spark):
    files = table_of(spark, {"a": b"x"})
    with pytest.raises(ValueError):
        grep.grep_files(files, "(")
    assert grep.grep_files(files, "(", fixed=True).count() == 0
