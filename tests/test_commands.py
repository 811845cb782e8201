import os

import pytest

from filescape.operators.cleanup import cleanup_summary
from filescape.plans import commands
from filescape.session import cut, release

TREE = {
    "a_1.txt": "hello\nneedle here\n",
    "sub/a_2.txt": "hello\nneedle here\n",
    "sub/c.go": "package main // Needle",
    "sub/.hidden": "needle",
    ".git/config": "needle",
}


@pytest.fixture
def root(make_tree):
    return make_tree(TREE)


def test_scan_listing_and_clean(spark, root):
    result = commands.scan(spark, root)
    assert tuple(result.summary.collect()[0]) == (3, 1, 58, 1, 18)
    assert [r["path"] for r in result.largest.collect()][0] == f"{root}/sub/c.go"
    assert result.duplicates.collect()[0]["copies"] == 2
    assert [r["ext"] for r in result.ext_stats.collect()] == [".txt", ".go"]
    shown = [(r["shown"], r["dup_label"]) for r in commands.listing(result, root).collect()]
    assert shown == [(f"{os.path.basename(root)}/", ""), ("a_1.txt", "D1"), ("sub/", ""), ("a_2.txt", "D1"), ("c.go", "")]
    assert tuple(cleanup_summary(commands.clean(result)).collect()[0]) == (1, 1, 18)


def test_find_search_grep_and_templates(spark, root):
    found = commands.find(spark, root, exts="txt", min_size="0.01KB").collect()
    assert [r["ext_count"] for r in found] == [2, 2]
    assert [r["path"] for r in commands.search(spark, root, "txt a").collect()] == [
        f"{root}/a_1.txt",
        f"{root}/sub/a_2.txt",
    ]
    assert commands.build_index(spark, root).where("token = 'a'").count() == 2
    matches, skipped = commands.grep(spark, root, "needle", ignore_case=True, max_size=20)
    assert [(r["path"], r["line"]) for r in matches.collect()] == [
        (f"{root}/a_1.txt", 2),
        (f"{root}/sub/a_2.txt", 2),
    ]
    assert [r["path"] for r in skipped.collect()] == [f"{root}/sub/c.go"]
    mined = commands.mine_patterns(spark, root).collect()
    assert {r["template"] for r in mined} == {"a_{1}.txt"}
    assert commands.search(spark, root, "hidden", include_all=True).count() == 1


def test_drive(spark):
    from tests.test_sources import listing

    result = commands.scan_drive(listing(spark))
    assert tuple(result.summary.collect()[0]) == (6, 3, 16, 2, 7)


def test_release(spark):
    release(spark)
    kept = cut(spark.range(3))
    assert kept.count() == 3
    assert release(spark) == 1
    assert release(spark) == 0
