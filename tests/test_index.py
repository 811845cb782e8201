import random

from filescape.operators import index, scope


def files_of(spark, *paths):
    return spark.createDataFrame(
        [(p, p.rsplit("/", 1)[-1]) for p in paths], "path string, name string"
    )


PATHS = [
    "/shop/Invoice-2031 harbour.csv",
    "/shop/harbour_plan.svg",
    "/shop/tides/HARBOUR, invoice.csv",
    "/shop/tides/ferry.log",
]


def found(df):
    return [r["path"] for r in df.collect()]


def test_search_ad_hoc_and_stored(spark, tmp_path):
    files = files_of(spark, *PATHS)
    index.save_index(index.name_index(files), str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    cases = {
        "harbour": PATHS[:3],
        "csv": [PATHS[0], PATHS[2]],
        "Invoice+harbour invoice": [PATHS[0], PATHS[2]],
        "2031 CSV": [PATHS[0]],
        "harb": [],
        "ferry plan": [],
        "?!": [],
    }
    for query, expected in cases.items():
        assert found(index.name_search(files, query)) == expected
        assert found(index.index_search(stored, query)) == expected
    queries = spark.createDataFrame([(q, q) for q in cases], "query_id string, query string")
    expected = sorted((q, p) for q, paths in cases.items() for p in paths)
    for hot_rows, hot_sets in ((1, 1), (2, 1), (100, 1), (1, 100), (100, 100)):
        pairs = index.search_many(stored, queries, hot_rows, hot_sets).select("query_id", "path").collect()
        assert sorted(map(tuple, pairs)) == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def shuffled_above_scan(plan, table):
    """Whether an exchange lies between the scan of a table and the join above it."""
    at = next(i for i, line in enumerate(plan) if "FileScan" in line and f"{table}[" in line.replace("default.", ""))
    depth = len(plan[at]) - len(plan[at].lstrip(" :+-"))
    for line in reversed(plan[:at]):
        own = len(line) - len(line.lstrip(" :+-"))
        if own < depth:
            depth = own
            if "Join" in line:
                return False
            if "Exchange" in line:
                return True
    raise AssertionError(plan)


def test_stored_index(spark, tmp_path):
    random.seed(5)
    paths = [f"/d{i % 7}/{'hot' if i % 3 else 'cold'} n{i % 5} r{random.randrange(40)}.txt" for i in range(300)] + PATHS + PATHS[:1]
    files = files_of(spark, *paths)
    stored = index.StoredIndex.build(files, "names_test", str(tmp_path / "stored"), buckets=4, block_size=10, per_slot=2)
    blocks = stored.blocks.collect()
    assert max(len(b["offsets"]) for b in blocks) <= 10
    assert all(b["offsets"][0] == 0 and b["first"] + b["offsets"][-1] == b["last"] for b in blocks)
    hot = {b["slot"] for b in blocks if b["slot"].startswith("hot/")}
    assert len(hot) == 10  # 200 postings, 20 to a slot
    cases = ["hot", "hot n1", "n2 txt cold", "harbour", "Invoice+harbour invoice", "harb", "", "r3 r3 hot", "hot N1"]
    folded = index.name_index(files)
    for case in cases:
        assert found(stored.search(case)) == found(index.name_search(files, case)) == found(index.index_search(folded, case))
    queries = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "query_id int, query string")
    many = sorted(map(tuple, stored.search_many(queries).select("query_id", "path").collect()))
    assert many == sorted((i, p) for i, c in enumerate(cases) for p in found(index.name_search(files, c)))
    # a search reads the buckets of its tokens, and what is stored is not shuffled
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert any("SelectedBucketsCount: 1 out of 4" in line for line in plan_of(stored.search("harbour csv")))
        plan = plan_of(stored.search_many(queries))
    finally:
        for name in settings:
            spark.conf.unset(name)
    for part in ("blocks", "files", "tokens"):
        assert not shuffled_above_scan(plan, f"names_test_{part}")


def test_largest_task_of_a_frequent_token(spark):
    """Postings and queries of one token meet in cells of about equal size."""
    names = [f"/a/hot x{i % 90}y.txt" for i in range(1800)]
    postings = index.name_index(files_of(spark, *names)).where("token != 'txt'")
    queries = spark.range(200).selectExpr("id as query_id", "concat('hot x', id % 100, 'y z', id) as query")
    found_ = index.search_many(postings, queries.selectExpr("query_id", "substring_index(query, ' z', 1) as query"), 10, 5)
    assert found_.groupBy("query_id").count().count() == 180
    one = queries.selectExpr("query_id", "'hot' as query")
    assert index.search_many(postings, one, 100, 5).count() == 200 * 1800


def test_sketches(spark):
    first, second = files_of(spark, *[f"/a/t{i}.x" for i in range(3000)]), files_of(spark, *[f"/b/t{i}.y" for i in range(2000, 5000)])
    nothing = files_of(spark, "/c/---")
    sketches = index.token_sketch(first).unionByName(index.token_sketch(second)).unionByName(index.token_sketch(nothing))
    row = index.sketch_stats(index.merged_sketch(sketches)).first()
    assert row["files"] == 6001 and abs(row["tokens"] - 5002) < 100
    assert tuple(index.sketch_stats(index.token_sketch(nothing)).first()) == (1, 0)
    assert tuple(index.sketch_stats(index.token_sketch(first.limit(0))).first()) == (0, 0)


def test_index_and_stats(spark):
    files = files_of(spark, *PATHS)
    postings = index.name_index(files)
    assert sorted(found(postings.where("token = 'harbour'"))) == PATHS[:3]
    assert tuple(index.index_stats(files).collect()[0]) == (4, 8)
    repeated = files_of(spark, "/a/x-x.x")
    assert index.name_index(repeated).count() == 1


def test_blocks_hold_whole_lists_in_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    random.seed(3)
    paths = [f"/d/{random.randrange(10**6)}-{i}/{'hot' if i % 3 else 'cold'} n{i % 5}.txt" for i in range(400)]
    postings = index.name_index(files_of(spark, *paths))
    blocks = index.posting_blocks(postings, 30).orderBy("token", "block").collect()
    assert max(len(b["paths"]) for b in blocks) <= 30
    lists = {}
    for block in blocks:
        lists.setdefault(block["token"], []).extend(block["paths"])
    assert lists["txt"] == sorted(paths)
    assert lists["hot"] == sorted(p for p in paths if "hot" in p)
    assert lists["n0"] == sorted(p for p in paths if " n0." in p)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_letters_fold_one_by_one(spark):
    files = files_of(spark, "/x/\u0130stanbul.txt", "/x/\u039f\u0394\u039f\u03a3\u0391.txt")
    assert found(index.name_search(files, "istanbul")) == ["/x/\u0130stanbul.txt"]
    assert found(scope.name_contains(files, "\u039f\u0394\u039f\u03a3")) == ["/x/\u039f\u0394\u039f\u03a3\u0391.txt"]


def test_blocks_of_frequent_tokens_are_not_shuffled_whole(spark):
    """Frequent and rare tokens give the same blocks; null and equal paths stay."""
    paths = [f"/d{i % 13}/{'hot' if i % 3 else 'cold'} n{i % 40}.txt" for i in range(700)]
    rows = [(p, p.rsplit("/", 1)[-1]) for p in paths] + [(None, "hot x.txt")] * 2
    postings = index.name_index(spark.createDataFrame(rows, "path string, name string"))
    lists = {}
    for name in {t for _, n in rows for t in index.query_terms(n)}:
        own = sorted((p for p, n in rows if name in index.query_terms(n)), key=lambda p: (p is not None, p or ""))
        lists |= {(name, at // 30): own[at : at + 30] for at in range(0, len(own), 30)}
    for hot in (5, 100, 10_000):
        blocks = index.posting_blocks(postings, 30, hot_postings=hot).collect()
        assert {(b["token"], b["block"]): b["paths"] for b in blocks} == lists and len(blocks) == len(lists)
