import os

import pytest

from filescape.operators import cleanup, dedup, stats, tree
from filescape.session import build_session, checkpoint_dir
from filescape.sources import catalog, content, manifest

FOLDER = "application/vnd.google-apps.folder"
DOC = "application/vnd.google-apps.document"
SHORTCUT = "application/vnd.google-apps.shortcut"

SMALL = {
    "north.csv": "ebb,1",
    "tides/south.csv": "ebb,1",
    "tides/ferry.log": "late again\n",
    ".git/HEAD": "no",
    "node_modules/x/y/z.js": "no",
}


def test_scan(spark, make_tree):
    root = make_tree(SMALL)
    nodes = catalog.file_catalog(spark, root)
    files = content.hash_files(catalog.catalog_files(nodes))
    summary = stats.scan_summary(files, nodes.where("is_dir")).collect()[0]
    assert files.count() == 3
    assert (summary["total_dirs"], summary["dup_groups"], summary["wasted_size"]) == (1, 1, 5)


def test_unread_files_count_in_the_summary(spark, make_tree):
    nodes = catalog.file_catalog(spark, make_tree(SMALL))
    files = content.hash_files(catalog.catalog_files(nodes))
    summary = stats.scan_summary(files, nodes.where("is_dir")).collect()[0]
    assert (summary["total_files"], summary["total_size"]) == (3, 21)
    kept = cleanup.unique_files(files).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in kept) == ["ferry.log", "north.csv"]


def test_include_all(spark, make_tree):
    root = make_tree({".git/config": "x"})
    assert catalog.catalog_files(catalog.file_catalog(spark, root)).count() == 0
    assert catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True)).count() == 1


def test_catalog_against_walk(spark, make_tree, monkeypatch):
    files = {f"d{i % 7}/e{i % 3}/{'x' * (i % 5 + 1)}_{i}.txt": "y" * i for i in range(60)}
    root = make_tree({**files, "_u/__init__.py": "", "a b.txt": "1", "ü.txt": "2", "vendor": "f"})
    os.makedirs(f"{root}/empty/deep")
    os.makedirs(f"{root}/sub/vendor")
    os.symlink(f"{root}/a b.txt", f"{root}/link.txt")
    os.symlink(f"{root}/d0", f"{root}/linked_dir")
    monkeypatch.setattr(catalog, "_FIRST_BUDGET", 3)
    monkeypatch.setattr(catalog, "_LAST_BUDGET", 4)
    nodes = catalog.file_catalog(spark, root).collect()
    found = {r["path"]: (r["is_dir"], r["is_symlink"], r["size"], r["parent"]) for r in nodes}
    assert len(found) == len(nodes)
    expected = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if not d.startswith(".") and d != "vendor"]
        for name in dirs + names:
            path = os.path.join(folder, name)
            link = os.path.islink(path)
            is_dir = os.path.isdir(path) and not link
            size = 0 if is_dir else os.lstat(path).st_size
            expected[path] = (is_dir, link, size, folder)
    assert found == expected
    stamp = next(r["mtime"] for r in nodes if r["name"] == "a b.txt")
    assert abs(stamp.timestamp() - os.stat(f"{root}/a b.txt").st_mtime) < 1


def test_root_must_be_a_directory(spark, make_tree):
    root = make_tree({"a": "x"})
    with pytest.raises(NotADirectoryError):
        catalog.file_catalog(spark, f"{root}/a")
    with pytest.raises(FileNotFoundError):
        catalog.file_catalog(spark, f"{root}/none")
    with pytest.raises(ValueError):
        catalog.file_catalog(spark, root, on_error="maybe")


def test_two_stage_hash_equals_full_hash(spark, make_tree):
    files = {f"{i}.bin": bytes([i % 4]) * (i % 9) for i in range(50)}
    listed = catalog.catalog_files(catalog.file_catalog(spark, make_tree(files)))
    full = dedup.duplicate_groups(content.hash_files(listed, hash_all=True)).collect()
    for hot_rows in (2, 10**6):
        lazy = content.hash_files(listed, hot_rows=hot_rows)
        assert lazy.count() == 50
        assert dedup.duplicate_groups(lazy).collect() == full


def listing(spark):
    rows = [
        ("A", "A", "root", FOLDER, 0, None, "2024-01-02T03:04:05Z", False),
        ("B", "B", "A", FOLDER, 0, None, None, False),
        ("B2", "B", "A", FOLDER, 0, None, None, False),
        ("T", "T", "root", FOLDER, 0, None, None, True),
        ("in_t", "hidden.txt", "T", "text/plain", 5, "m0", None, False),
        ("t2", "T2", "T", FOLDER, 0, None, None, False),
        ("in_t2", "hidden2.txt", "t2", "text/plain", 5, "m0", None, False),
        ("f1", "x.pdf", "B", "application/pdf", 7, "m1", "bad", False),
        ("f2", "x.pdf", "B", "application/pdf", 7, "m1", None, False),
        ("f3", "y.pdf", "B2", "application/pdf", 9, "m1", None, True),
        ("d1", "Plan", "root", DOC, None, None, None, False),
        ("d2", "Plan", "A", DOC, None, None, None, False),
        ("s1", "go", "A", SHORTCUT, None, None, None, None),
        ("lost", "lost.txt", "nowhere", "text/plain", 1, "m9", None, False),
        ("c1", "C1", "c2", FOLDER, 0, None, None, False),
        ("c2", "C2", "c1", FOLDER, 0, None, None, False),
        ("in_c", "c.txt", "c1", "text/plain", 1, "m8", None, False),
        (".h", ".hidden", "root", "text/plain", 2, "m7", None, False),
    ]
    from filescape.schema import MANIFEST

    return spark.createDataFrame(rows, MANIFEST)


def test_drive_paths(spark):
    for hot_rows in (1, 10**6):
        nodes = manifest.manifest_nodes(listing(spark), hot_rows=hot_rows).collect()
        assert {r["id"]: r["path"] for r in nodes} == {
            "A": "My Drive/A",
            "B": "My Drive/A/B",
            "B2": "My Drive/A/B",
            "f1": "My Drive/A/B/x.pdf",
            "f2": "My Drive/A/B/x.pdf",
            "d1": "My Drive/Plan",
            "d2": "My Drive/A/Plan",
            "s1": "My Drive/A/go",
            ".h": "My Drive/.hidden",
        }
    by_id = {r["id"]: r for r in nodes}
    assert by_id["A"]["mtime"].year == 2024 and by_id["f1"]["mtime"] is None
    assert by_id["d1"]["size"] == 0 and by_id["s1"]["type_label"] == "Google Drive shortcut"


def test_deep_folders_take_few_rounds(spark, monkeypatch):
    """A chain of 1,000 folders, a cycle, and a folder listed twice, once below itself."""
    depth = 1000
    rows = [(f"d{i}", f"n{i}", "root" if i == 0 else f"d{i - 1}", FOLDER) for i in range(depth)]
    rows += [("c1", "c1", "c3", FOLDER), ("c2", "c2", "c1", FOLDER), ("c3", "c3", "c2", FOLDER), ("in_c", "x", "c2", DOC)]
    rows += [("twice", "t", "d0", FOLDER), ("below", "b", "twice", FOLDER), ("twice", "t", "below", FOLDER), ("leaf", "leaf", f"d{depth - 1}", DOC)]
    from filescape.schema import MANIFEST

    listed = spark.createDataFrame([(i, n, p, m, 1, None, None, False) for i, n, p, m in rows], MANIFEST)
    rounds = []
    monkeypatch.setattr(manifest, "cut", lambda df, cut=manifest.cut: rounds.append(1) or cut(df))
    found = [(r["id"], r["path"]) for r in manifest.manifest_nodes(listed).select("id", "path").collect()]
    assert len(rounds) <= 12  # the first state and 11 rounds
    chain = "My Drive/" + "/".join(f"n{i}" for i in range(depth))
    assert ("leaf", f"{chain}/leaf") in found and (f"d{depth - 1}", chain) in found
    assert sorted(path for i, path in found if i in ("twice", "below")) == ["My Drive/n0/t", "My Drive/n0/t/b", "My Drive/n0/t/b/t"]
    assert not {i for i, _ in found} & {"c1", "c2", "c3", "in_c"}


def test_drive_groups_and_sizes(spark):
    nodes = manifest.manifest_nodes(listing(spark))
    groups = dedup.duplicate_groups(manifest.manifest_files(nodes)).collect()
    assert [(g["dedup_key"], g["copies"], g["first_id"]) for g in groups] == [
        ("md5:m1", 2, "f1"),
        ("namesize:Plan:0", 2, "d2"),
    ]
    sizes = {r["id"]: (r["size"], r["files"]) for r in tree.folder_sizes(nodes).collect()}
    assert sizes == {"root": (16, 6), "A": (14, 4), "B": (14, 2), "B2": (0, 0)}


def test_drive_sub_folder(spark):
    by_name = manifest.manifest_nodes(listing(spark), "A")
    assert {r["path"] for r in by_name.collect()} == {"A/B", "A/B/x.pdf", "A/Plan", "A/go"}
    in_cycle = manifest.manifest_nodes(listing(spark), explicit_id="c1")
    assert {r["path"] for r in in_cycle.collect()} == {"C1/C2", "C1/c.txt"}


def test_resolve_folder(spark):
    rows = listing(spark)
    for target in ("", "root", "My DRIVE"):
        assert manifest.resolve_folder(rows, target) == ("root", "My Drive")
    assert manifest.resolve_folder(rows, "A") == ("A", "A")
    assert manifest.resolve_folder(rows, explicit_id="B2") == ("B2", "B")
    for bad in ({"target": "B"}, {"target": "none"}, {"target": "T"}, {"target": "x.pdf"}):
        with pytest.raises(ValueError):
            manifest.resolve_folder(rows, **bad)
    for bad_id in ("none", "f1"):
        with pytest.raises(ValueError):
            manifest.resolve_folder(rows, explicit_id=bad_id)


def test_stored_manifest(spark, tmp_path):
    listing(spark).write.json(str(tmp_path / "m"))
    assert manifest.read_manifest(spark, str(tmp_path / "m"), "json").count() == 16


def test_the_named_checkpoint_folder_is_used(spark):
    assert checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert build_session() is not None
