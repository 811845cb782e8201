import os
from urllib.parse import urlparse

import pytest

from filescape.session import checkpoint_dir, cut, free, release
from filescape.sources import manifest

FOLDER = "application/vnd.google-apps.folder"


def files_below(folder):
    return [name for _, _, names in os.walk(urlparse(folder).path) for name in names]


def test_written_tables_are_freed_and_released(spark):
    release(spark)
    shared = f"{checkpoint_dir(spark)}/filescape"
    first, second = cut(spark.range(5)), cut(spark.range(7))
    assert (first.count(), second.count()) == (5, 7)
    free(first, first)
    assert second.count() == 7
    release(spark)
    assert files_below(shared) == []


def test_all_folders_of_a_name(spark):
    rows = [(f"f{i}", "Charts", "root", FOLDER, 0, None, i == 3) for i in range(40)]
    listing = spark.createDataFrame(rows, "id string, name string, parent_id string, mime_type string, size long, md5 string, trashed boolean")
    assert manifest.folder_candidates(listing, "Charts").count() == 39
    with pytest.raises(ValueError, match="folder_candidates"):
        manifest.resolve_folder(listing, "Charts")
    assert manifest.resolve_folder(listing, explicit_id="root")[0] == "root"


def test_a_listing_that_loops_ends(spark):
    rows = [("A", "a", "root", FOLDER, 0, None, False), ("B", "b", "A", FOLDER, 0, None, False), ("A", "a", "B", FOLDER, 0, None, False), ("f", "x.txt", "B", "text/plain", 3, "m", False)]
    listing = spark.createDataFrame(rows, "id string, name string, parent_id string, mime_type string, size long, md5 string, trashed boolean")
    nodes = manifest.manifest_nodes(listing)
    assert [r["path"] for r in manifest.manifest_files(nodes).collect()] == ["My Drive/a/b/x.txt"]
