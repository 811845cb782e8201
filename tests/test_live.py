"""Live trees: byte ranges, chunks, staged hashes and the data source."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from filescape.sources import catalog, content, filetree

MIB = 1 << 20


def files_of(spark, root):
    return catalog.catalog_files(catalog.file_catalog(spark, root, include_all=True))


def plain_lines(data, cap=None):
    """(number, text) of the lines of a file, read as one value."""
    lines = data.split(b"\n")
    if not lines[-1]:
        lines.pop()
    if lines and b"\0" in lines[0]:
        return []
    out = []
    for number, line in enumerate(lines, 1):
        if cap is not None and len(line) >= cap:
            break
        out.append((number, line.removesuffix(b"\r").decode()))
    return out


def random_files(count=25):
    rng = random.Random(3)
    made = {}
    for i in range(count):
        pieces = [rng.choice(["", "\r", "pearl", "x" * rng.randrange(60), "a pearl b\r", "\n\n"]) for _ in range(rng.randrange(40))]
        made[f"d{i % 3}/{i}.txt"] = ("\n".join(pieces) + rng.choice(["", "\n"])).encode()
    made["d0/first.bin"] = b"a" * 50 + b"\0" + b"\npearl\n" * 30
    made["d0/later.txt"] = b"pearl\n" * 30 + b"\0\npearl\n"
    made["d0/empty.txt"] = b""
    made["d0/one.txt"] = b"y" * 500 + b"pearl"
    return made


@pytest.mark.parametrize("cap", [None, 40])
@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_ranges(spark, make_tree, step, cap):
    made = random_files()
    root = make_tree(made)
    files = files_of(spark, root)
    expected = {(f"{root}/{path}", n, text) for path, data in made.items() for n, text in plain_lines(data, cap)}
    lines = [tuple(r) for r in content.file_lines(files, cap, range_bytes=step).collect()]
    assert len(lines) == len(expected) and set(lines) == expected
    found = [tuple(r) for r in content.grep_catalog(files, "p[e]arl", max_line_bytes=cap, range_bytes=step).collect()]
    assert sorted(found) == sorted(row for row in expected if "pearl" in row[2])
    assert [row[:2] for row in found] == sorted(row[:2] for row in found)


def test_one_file_over_several_tasks(spark, make_tree):
    data = b"".join(b"line %d%s\n" % (i, b" pearl" if i % 1000 == 0 else b"") for i in range(100_000))
    files = files_of(spark, make_tree({"big.txt": data}))
    ranges = content._ranges(files, MIB // 4).repartition(8)
    assert ranges.select(F.spark_partition_id()).distinct().count() > 2
    found = content.grep_catalog(files, "pearl", range_bytes=MIB // 4, tasks=8)
    assert [r["line"] for r in found.collect()] == list(range(1, 100_001, 1000))


def test_line_longer_than_many_ranges(spark, make_tree):
    data = b"a\n" + b"x" * (3 * MIB) + b" pearl\nb pearl\n" + b"y" * (2 * MIB)
    files = files_of(spark, make_tree({"long.txt": data}))
    found = content.grep_catalog(files, "pearl", range_bytes=MIB // 2).collect()
    assert [(r["line"], len(r["text"])) for r in found] == [(2, 3 * MIB + 6), (3, 7)]


def test_chunks(spark, make_tree):
    made = {"a": b"", "b": b"x" * 10, "c": b"y" * 11, "d": bytes(range(256)) * 5}
    root = make_tree(made)
    rows = content.file_content(files_of(spark, root), chunk_bytes=10).collect()
    for name, data in made.items():
        own = sorted((r for r in rows if r["path"] == f"{root}/{name}"), key=lambda r: r["number"])
        assert [r["number"] for r in own] == list(range(max(1, -(-len(data) // 10))))
        assert b"".join(bytes(r["content"]) for r in own) == data
        assert [r["digest"] for r in own] == [hashlib.sha256(data[: 10 * (i + 1)]).hexdigest() for i in range(len(own))]


def test_large_sparse_file(spark, tmp_path):
    """3 GB are hashed and read in chunks; a worker's memory stays below 200 MB."""
    size = 3 << 30
    (tmp_path / "sparse").mkdir()
    with open(tmp_path / "sparse" / "zeros.bin", "wb") as stream:
        stream.truncate(size)
    files = files_of(spark, str(tmp_path / "sparse"))
    state, block = hashlib.sha256(), bytes(64 * MIB)
    for _ in range(size // len(block)):
        state.update(block)
    assert content.file_hashes(files, tasks=1).first()["dedup_key"] == state.hexdigest()
    chunks = content.file_content(files, tasks=1, chunk_bytes=8 * MIB)

    def peak(batches):
        import resource

        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

    read = chunks.agg(F.sum(F.octet_length("content").cast("bigint")), F.max_by("digest", "number")).first()
    assert tuple(read) == (size, state.hexdigest())
    assert spark.range(1).mapInArrow(peak, "mb bigint").first()["mb"] < 200


def test_staged_hashes_read_little(spark, make_tree):
    made = {
        "same1": b"a" * 100, "same2": b"a" * 100, "middle1": b"b" * 40 + b"1" * 20 + b"b" * 40, "middle2": b"b" * 40 + b"2" * 20 + b"b" * 40,
        "head": b"c" + b"b" * 99, "tail": b"b" * 99 + b"c", "short1": b"z" * 8, "short2": b"z" * 8, "short3": b"y" * 8, "alone": b"q" * 55,
    }
    root = make_tree(made)
    hashed = {r["path"][len(root) + 1 :]: r["dedup_key"] for r in content.hash_files(files_of(spark, root), edge_bytes=10).collect()}
    key = lambda name: hashlib.sha256(made[name]).hexdigest()
    read = {"same1", "same2", "middle1", "middle2", "short1", "short2"}
    assert hashed == {name: key(name) if name in read else None for name in made}


TREE = {
    "north.csv": "ebb,1", "tides/south.CSV": "ebb,22", "tides/.cache/x.csv": "no", ".git/HEAD": "no", "node_modules/x/y.js": "no",
    "a/b/c/deep.log": "z" * 300, "vendor": "a file", ".hidden.csv": "h",
}


@pytest.fixture
def tree(spark, make_tree):
    filetree.register(spark)
    root = make_tree(TREE)
    os.symlink(f"{root}/north.csv", f"{root}/link.csv")
    os.makedirs(f"{root}/empty")
    return root


@pytest.mark.parametrize("partitions", [1, 2, 3, 64])
@pytest.mark.parametrize("include_all", [True, False])
def test_filetree_lists_the_catalog(spark, tree, partitions, include_all):
    read = spark.read.format("filetree").options(partitions=partitions, includeAll=include_all).load(tree)
    columns = ["id", "parent", "path", "name", "is_dir", "is_symlink", "size", "mtime"]
    found = [tuple(r) for r in read.select(*columns).collect()]
    expected = catalog.file_catalog(spark, tree, include_all=include_all)
    assert sorted(found) == sorted(tuple(r) for r in expected.select(*columns).collect())


def test_filetree_options_and_conditions(spark, tree):
    every = [r.asDict() for r in spark.read.format("filetree").option("includeAll", True).load(tree).collect()]
    paths = lambda df: sorted(r["path"] for r in df.collect())
    options = {
        ("exts", "csv,.JS"): lambda r: r["ext"] in (".csv", ".js"),
        ("minSize", "6"): lambda r: r["size"] >= 6,
        ("maxSize", "5"): lambda r: r["size"] <= 5,
    }
    for (name, value), holds in options.items():
        read = spark.read.format("filetree").option(name, value)
        expected = [r for r in every if holds(r) and not r["is_dir"]]
        assert paths(read.load(tree)) == sorted(r["path"] for r in expected if not r["hidden"])
        assert paths(read.option("includeAll", "true").load(tree)) == sorted(r["path"] for r in expected)
    read = spark.read.format("filetree").load(tree)  # one frame, used again and again
    logs, sheets = read.where("ext = '.log'"), read.where("ext = '.csv'")
    assert (logs.count(), sheets.count(), read.count(), logs.unionByName(sheets).count()) == (1, 3, 10, 4)


def _rows(reader):
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


def _names(reader):
    return sorted(row["name"] for row in _rows(reader))


def test_pushed_filters(tree):
    """What the reader is told to leave out, and what is left for Spark."""
    f = filetree
    everything = _rows(f.FileTreeReader({"path": tree, "includeAll": "true"}))
    cases = [
        (f.EqualTo(("ext",), ".csv"), lambda r: r["ext"] == ".csv"),
        (f.In(("ext",), (".csv", ".js")), lambda r: r["ext"] in (".csv", ".js")),
        (f.GreaterThan(("size",), 5), lambda r: r["size"] > 5),
        (f.LessThan(("size",), 6), lambda r: r["size"] < 6),
        (f.Not(f.EqualTo(("ext",), ".csv")), lambda r: r["ext"] != ".csv"),
        (f.StringStartsWith(("name",), "."), lambda r: r["name"].startswith(".")),
        (f.Not(f.StringEndsWith(("name",), ".csv")), lambda r: not r["name"].endswith(".csv")),
        (f.StringContains(("name",), "out"), lambda r: "out" in r["name"]),
        (f.EqualTo(("hidden",), True), lambda r: r["hidden"]),
        (f.EqualTo(("is_symlink",), True), lambda r: r["is_symlink"]),
    ]
    for one, holds in cases:
        reader = f.PushingReader({"path": tree, "includeAll": "true"})
        assert list(reader.pushFilters([f.IsNotNull(("ext",)), one])) == []
        assert _names(reader) == sorted(r["name"] for r in everything if holds(r)), one
    reader = f.PushingReader({"path": tree})
    left = [f.EqualTo(("mtime",), 0), f.EqualTo(("ext",), None), f.IsNotNull(("mtime",))]
    assert list(reader.pushFilters(left)) == left and not reader.tests


def test_filters_reach_the_listing(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("filetree").options(pushFilters=True, includeAll=True).load(tree)
        found = read.where("not hidden and ext = '.csv' and size > 1 and not is_symlink")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan
        assert sorted(r["name"] for r in found.collect()) == ["north.csv", "south.CSV"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("by_filter", [True, False])
def test_pruned_folders_are_not_listed(tree, by_filter):
    asked = []

    class Watched(filetree.PushingReader):
        def _entries(self, directory, hidden):
            asked.append(os.path.relpath(directory, tree))
            return super()._entries(directory, hidden)

    reader = Watched({"path": tree, "includeAll": by_filter, "exts": "csv"})
    if by_filter:
        assert list(reader.pushFilters([filetree.Not(filetree.EqualTo(("hidden",), True))])) == []
    assert _names(reader) == ["link.csv", "north.csv", "south.CSV"]
    assert not {path for path in asked if path.startswith((".git", "node_modules")) or ".cache" in path}
    asked.clear()
    assert len(_names(Watched({"path": tree, "includeAll": "true"}))) > 15
    assert {"node_modules/x", ".git", "tides/.cache"} <= set(asked)


def test_filetree_errors(spark, tree):
    source = spark.read.format("filetree")
    for path, error in ((f"{tree}/none", "FileNotFoundError"), (f"{tree}/north.csv", "NotADirectoryError")):
        with pytest.raises(Exception, match=error):
            source.load(path).collect()
    with pytest.raises(Exception, match="onError"):
        source.option("onError", "maybe").load(tree).collect()
