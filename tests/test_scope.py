from filescape.operators import scope, stats, tree


def listing(spark, *paths, sizes=None):
    rows = [(p, p.rsplit("/", 1)[-1], (sizes or {}).get(p, 1)) for p in paths]
    return spark.createDataFrame(rows, "path string, name string, size long")


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_hidden_and_noise(spark):
    files = listing(
        spark,
        "/r/a.txt",
        "/r/.x",
        "/r/.git/config",
        "/r/node_modules/p/i.js",
        "/r/d/vendor/a.go",
        "/r/d/vendor",
        "/r/Vendor/a",
        "/r/__pycache__x/a",
        "/r/_u/__init__.py",
        "/r/d/.h/deep/a",
        "/r/.DS_Store",
    )
    assert paths(scope.visible_files(files, "/r")) == [
        "/r/Vendor/a",
        "/r/__pycache__x/a",
        "/r/_u/__init__.py",
        "/r/a.txt",
        "/r/d/vendor",
    ]
    assert scope.visible_files(files, "/r", include_all=True).count() == 11


def test_the_root_itself_is_not_judged(spark):
    files = listing(spark, "/.home/vendor/a")
    assert paths(scope.visible_files(files, "/.home/vendor")) == ["/.home/vendor/a"]
    assert paths(scope.visible_files(listing(spark, "/a", "/.b"), "/")) == ["/a"]


def test_directories_named_like_noise(spark):
    nodes = spark.createDataFrame(
        [("/r/vendor", True), ("/r/x/vendor", False)], "path string, is_dir boolean"
    )
    assert paths(scope.visible_files(nodes, "/r")) == ["/r/x/vendor"]


def test_filters(spark):
    files = listing(
        spark, "/r/Report.PDF", "/r/note.txt", "/r/b.docx", sizes={"/r/Report.PDF": 10, "/r/b.docx": 5}
    )
    assert paths(scope.ext_filter(files, " PDF, .docx ,,")) == ["/r/Report.PDF", "/r/b.docx"]
    assert scope.ext_filter(files, ",").count() == 3
    assert paths(scope.name_contains(files, "REP")) == ["/r/Report.PDF"]
    assert scope.name_contains(files, "/r").count() == 0
    assert paths(scope.size_range(files, 5, 10)) == ["/r/Report.PDF", "/r/b.docx"]
    assert paths(scope.size_range(files, 0, 1)) == ["/r/note.txt"]
    assert scope.size_range(files, 0, 0).count() == 3
    found = scope.find_files(files, ["." + "docx"], "B", 1, 5).collect()
    assert [(r["path"], r["ext"], r["type_label"]) for r in found] == [
        ("/r/b.docx", ".docx", "Word document")
    ]
    assert stats.find_totals(scope.find_files(files, "zip")).collect()[0] == (0, 0)


def test_extension_totals_and_groups(spark):
    files = listing(
        spark, "/r/b.go", "/r/a.go", "/r/x", sizes={"/r/b.go": 3, "/r/a.go": 4, "/r/x": 100}
    )
    totals = [tuple(r) for r in stats.ext_stats(files).collect()]
    assert totals == [("(no extension)", 1, 100), (".go", 2, 7)]
    for hot_rows in (1, 2, 1000):
        grouped = stats.group_by_ext(files, hot_rows=hot_rows).collect()
        assert [(r["ext"], r["path"], r["ext_count"], r["ext_size"]) for r in grouped] == [
            ("(no extension)", "/r/x", 1, 100),
            (".go", "/r/a.go", 2, 7),
            (".go", "/r/b.go", 2, 7),
        ]


def test_largest(spark):
    files = listing(spark, "/a", "/b", "/c", sizes={"/a": 10, "/b": 30, "/c": 20})
    assert [r["size"] for r in stats.largest_files(files, 2).collect()] == [30, 20]
    assert stats.largest_files(files, 0).count() == 3


def test_directory_roll_up(spark):
    files = listing(
        spark, "/r/a", "/r/d/b", "/r/d/e/c", sizes={"/r/a": 1, "/r/d/b": 10, "/r/d/e/c": 100}
    )
    dirs = spark.createDataFrame([("/r/d",), ("/r/d/e",), ("/r/empty",)], "path string")
    found = {r["path"]: (r["size"], r["files"]) for r in tree.dir_sizes(files, "/r", dirs).collect()}
    assert found == {"/r": (111, 3), "/r/d": (110, 2), "/r/d/e": (100, 1), "/r/empty": (0, 0)}
    at_top = {r["path"]: r["size"] for r in tree.dir_sizes(files, "/").collect()}
    assert at_top == {"/": 111, "/r": 111, "/r/d": 110, "/r/d/e": 100}


def test_directory_of_hidden_files_still_counts(spark):
    files = listing(spark, "/r/d/.x", "/r/.h/a", "/r/node_modules/p/a", "/r/a")
    assert paths(tree.dirs_of(files, "/r")) == ["/r/d"]
    assert len(paths(tree.dirs_of(files, "/r", include_all=True))) == 4


def test_tree_order(spark):
    files = listing(spark, "/r/b.txt", "/r/A/z", "/r/A/y", "/r/a", "/r/a/k", "/r/B", "/r/A")
    order = [r["path"] for r in tree.tree_order(files, "/r").collect()]
    assert order == ["/r/A", "/r/A/y", "/r/A/z", "/r/a", "/r/a/k", "/r/B", "/r/b.txt"]
    placed = tree.tree_position(files.select("path"), "/r").orderBy("position").collect()
    assert [r["path"] for r in placed] == order
    assert [r["position"] for r in placed] == list(range(1, 8))


def test_tree_listing(spark):
    files = spark.createDataFrame(
        [("/root/a.txt", "a.txt", 5, "D1"), ("/root/sub/b.txt", "b.txt", 5, "D1")],
        "path string, name string, size long, dup_label string",
    )
    dirs = spark.createDataFrame([("/root/sub",)], "path string")
    assert [tuple(r) for r in tree.tree_listing(files, dirs, "/root").collect()] == [
        ("/root/a.txt", 1, False, "a.txt", "Text document", "5 B", "D1"),
        ("/root/sub", 1, True, "sub/", "", "5 B", ""),
        ("/root/sub/b.txt", 2, True, "b.txt", "Text document", "5 B", "D1"),
    ]


def test_largest_task_of_dir_sizes(spark):
    """Directories are added up in tasks of so many files, whatever the listing's size."""
    files = spark.range(400).selectExpr("concat('/r/', id % 7, '/', id % 90, '/f', id) as path", "id as size")
    sized = tree.dir_sizes(files, "/r", task_rows=10)
    assert "REPARTITION_BY_NUM" in (plan := sized._jdf.queryExecution().executedPlan().toString()) and ", 40)" in plan
    found = {r["path"]: (r["size"], r["files"]) for r in sized.collect()}
    assert found["/r"] == (sum(range(400)), 400)
    assert found["/r/3"] == (sum(range(3, 400, 7)), len(range(3, 400, 7)))
    assert sum(files for path, (_, files) in found.items() if path.count("/") == 3) == 400
