import json

import pytest

from filescape.operators import grep, index, patterns
from filescape.sinks import writers


def documents(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


@pytest.fixture
def files(spark):
    rows = [(f"/r/f_{i:02d}.txt", f"f_{i:02d}.txt", i) for i in range(25)]
    rows.append(("/r/x", "x", 1000))
    return spark.createDataFrame(rows, "path string, name string, size long")


def test_find_documents_are_whole(files, tmp_path):
    writers.write_output(writers.find_documents(files, per_document=10), str(tmp_path / "o"))
    found = sorted(documents(tmp_path / "o"), key=lambda d: (d["ext"], d["block"]))
    assert [(d["ext"], d["count"], d["size"], d["block"], len(d["files"])) for d in found] == [
        ("(no extension)", 1, 1000, 0, 1),
        (".txt", 25, 300, 0, 10),
        (".txt", 25, 300, 1, 10),
        (".txt", 25, 300, 2, 5),
    ]
    assert found[1]["files"][0] == {"path": "/r/f_00.txt", "size": 0, "type_label": "Text document"}
    assert [f["path"] for d in found[1:] for f in d["files"]] == [f"/r/f_{i:02d}.txt" for i in range(25)]


def test_pattern_documents(files, tmp_path):
    writers.write_patterns_json(patterns.name_patterns(files), str(tmp_path / "o"))
    (found,) = documents(tmp_path / "o")
    assert (found["template"], found["count"], len(found["files"])) == ("f_{1}.txt", 25, 25)
    assert found["files"][3] == {"path": "/r/f_03.txt", "fields": ["03"]}


def test_search_index_and_tree(files, tmp_path, spark):
    writers.write_search_json(index.name_search(files, "x"), str(tmp_path / "s"))
    assert documents(tmp_path / "s") == [{"path": "/r/x"}]
    writers.write_index_json(index.name_index(files), str(tmp_path / "i"))
    lists = {d["token"]: d["paths"] for d in documents(tmp_path / "i")}
    assert lists["x"] == ["/r/x"] and len(lists["txt"]) == 25
    nodes = files.selectExpr("path", "'/r' as parent", "name", "false as is_dir", "size")
    writers.write_tree_json(nodes, str(tmp_path / "t"))
    assert {"path": "/r/x", "parent": "/r", "name": "x", "is_dir": False, "size": 1000, "ext": "", "type_label": "File (no extension)"} in documents(tmp_path / "t")


def test_figures_next_to_the_rows(files, tmp_path, spark):
    more = files.unionByName(spark.createDataFrame([("/r/---", "---", 5)], files.schema))
    writers.write_index_json(index.name_index(more), str(tmp_path / "i"), block_size=10, files=more)
    assert documents(tmp_path / "i_stats") == [{"files": 27, "tokens": 28, "postings": 76}]
    writers.write_index_json(index.name_index(more.limit(0)), str(tmp_path / "e"))
    assert documents(tmp_path / "e_stats") == [{"files": 0, "tokens": 0, "postings": 0}]
    rows = [("/r", "r", True, 30, None), ("/r/d", "d", True, 20, None), ("/r/a", "a", False, 10, "k"), ("/r/d/b", "b", False, 10, "k"), ("/r/d/c", "c", False, 10, "m")]
    nodes = spark.createDataFrame(rows, "path string, name string, is_dir boolean, size long, dedup_key string").selectExpr("*", "'' as parent")
    writers.write_tree_json(nodes, str(tmp_path / "t"), root="/r")
    assert documents(tmp_path / "t_stats") == [{"dup_groups": 1, "wasted_size": 10, "files": 3, "dirs": 1, "size": 30}]


def test_grep_sinks(spark, tmp_path):
    table = spark.createDataFrame(
        [("/a:b", "a", 9, b"ok \xff one\ntwo\n")], "path string, name string, size long, raw binary"
    ).selectExpr("path", "name", "size", "cast(raw as string) as content")
    matches = grep.grep_files(table, "o")
    writers.write_grep_json(matches, str(tmp_path / "j"))
    assert documents(tmp_path / "j")[0] == {"path": "/a:b", "line": 1, "text": "ok � one"}
    writers.write_grep_text(matches, str(tmp_path / "t"))
    lines = [line for part in sorted((tmp_path / "t").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[1] == "/a:b:2:two"


def test_empty_results_and_modes(files, tmp_path):
    writers.write_search_json(index.name_search(files, "none"), str(tmp_path / "s"))
    assert documents(tmp_path / "s") == []
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_search_json(index.name_search(files, "x"), str(tmp_path / "s"))
    writers.write_search_json(index.name_search(files, "x"), str(tmp_path / "s"), mode="overwrite")
    assert len(documents(tmp_path / "s")) == 1
