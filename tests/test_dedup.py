import random

import pytest

from filescape.operators import cleanup, dedup, stats
from filescape.operators.ranking import global_rank, rank_within
from filescape.operators.skew import attach


def keyed(spark, rows):
    return spark.createDataFrame(rows, "path string, size long, dedup_key string")


def skewed_rows(n=300):
    """A third of all rows share one key, the rest have few copies."""
    random.seed(7)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{random.randrange(n // 2)}"
        out.append((f"/f/{random.randrange(10**9):09d}-{i}", 3 if key == "hot" else 1, key))
    return out


def by_key(rows):
    groups = {}
    for path, size, key in rows:
        groups.setdefault(key, []).append((path, size))
    return {k: sorted(v) for k, v in groups.items() if len(v) > 1}


def test_groups_tags_and_waste(spark):
    files = keyed(spark, [("/q/2", 7, "kk"), ("/q/1", 7, "kk"), ("/p", 4, "ll"), ("/q/3", 7, "kk"), ("/n", 1, None), ("/m", 1, None)])
    groups = dedup.duplicate_groups(files).collect()
    assert [(g["label"], g["copies"], g["first_path"], g["wasted"]) for g in groups] == [("D1", 3, "/q/1", 14)]
    tags = {r["path"]: r["dup_label"] for r in dedup.tag_duplicates(files).collect()}
    assert tags == {"/q/1": "D1", "/q/2": "D1", "/q/3": "D1", "/p": "", "/n": "", "/m": ""}
    assert tuple(dedup.wasted_size(files).collect()[0]) == (1, 14)
    dirs = spark.createDataFrame([("/d",)], "path string")
    assert stats.scan_summary(files, dirs).collect()[0].asDict() == {
        "total_files": 6,
        "total_dirs": 1,
        "total_size": 27,
        "dup_groups": 1,
        "wasted_size": 14,
    }


def test_plans_hash_content_once_and_keep_it_out_of_shuffles(spark):
    files = spark.createDataFrame([("/a", 1, "x"), ("/b", 1, "x")], "path string, size long, content string")
    keyed_files = dedup.with_content_key(files)
    dirs = spark.createDataFrame([("/d",)], "path string")
    frames = [dedup.wasted_size(keyed_files), stats.scan_summary(keyed_files, dirs)]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("sha2(") == 1 and "SortAggregate" not in plan and "HashAggregate" in plan
        assert not [line for line in plan.splitlines() if "Exchange" in line and "content" in line]


def test_no_files(spark):
    files = keyed(spark, [("/a", 1, "k")]).where("false")
    assert tuple(dedup.wasted_size(files).collect()[0]) == (0, 0)
    assert dedup.duplicate_groups(files).count() == 0
    assert dedup.tag_duplicates(files).count() == 0


def test_skewed_groups_against_brute_force(spark):
    rows = skewed_rows()
    expected = by_key(rows)
    files = keyed(spark, rows).repartition(5)
    firsts = sorted(expected, key=lambda k: expected[k][0])
    labels = {key: f"D{i}" for i, key in enumerate(firsts, start=1)}
    for hot_rows in (1, 10, 10**6):
        tags = {r["path"]: r["dup_label"] for r in dedup.tag_duplicates(files, hot_rows=hot_rows).collect()}
        assert tags == {path: labels.get(key, "") for path, _, key in rows}
        members = dedup.duplicate_members(files, hot_rows=hot_rows).collect()
        found = {(m["dup_label"], m["copy"], m["path"]) for m in members}
        assert found == {
            (labels[key], i, path)
            for key, files_of in expected.items()
            for i, (path, _) in enumerate(files_of, start=1)
        }


def test_labels_follow_the_first_path(spark):
    files = keyed(spark, [("/z", 1, "a"), ("/y", 1, "a"), ("/b", 1, "z"), ("/c", 1, "z")])
    assert [(g["label"], g["dedup_key"]) for g in dedup.duplicate_groups(files).collect()] == [
        ("D1", "z"),
        ("D2", "a"),
    ]


def test_paths_that_repeat(spark):
    files = spark.createDataFrame(
        [("2", "/a", 1, "k"), ("1", "/a", 4, "k")], "id string, path string, size long, dedup_key string"
    )
    group = dedup.duplicate_groups(files).collect()[0]
    assert (group["first_id"], group["wasted"]) == ("1", 4)
    assert {r["id"]: r["copy"] for r in dedup.duplicate_members(files).collect()} == {"1": 1, "2": 2}


@pytest.fixture(params=["true", "false"])
def coalescing(spark, request):
    """With and without merging of small partitions; without it, hot groups span blocks."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_ranks_against_brute_force(spark, coalescing):
    rows = skewed_rows(500)
    frame = keyed(spark, rows).repartition(7)
    everywhere = {r["path"]: r["rank"] for r in global_rank(frame, ["path"]).collect()}
    assert everywhere == {path: i for i, path in enumerate(sorted(r[0] for r in rows), start=1)}
    inside = {r["path"]: r["rank"] for r in rank_within(frame, ["dedup_key"], ["path"]).collect()}
    expected = {}
    for key in {r[2] for r in rows}:
        for i, path in enumerate(sorted(r[0] for r in rows if r[2] == key), start=1):
            expected[path] = i
    assert inside == expected


def test_attach_keeps_every_row(spark):
    rows = spark.createDataFrame(
        [("a", "1"), ("a", "2"), ("b", "3"), (None, "4"), ("c", "5")], "k string, id string"
    )
    facts = spark.createDataFrame([("a", 2, "A"), ("b", 1, "B"), ("z", 9, "Z")], "k string, n long, v string")
    for hot_rows in (1, 2, 100):
        left = {r["id"]: r["v"] for r in attach(rows, facts, "k", "n", "id", hot_rows=hot_rows).collect()}
        assert left == {"1": "A", "2": "A", "3": "B", "4": None, "5": None}
        inner = attach(rows, facts, "k", "n", "id", "inner", hot_rows)
        assert {r["id"] for r in inner.collect()} == {"1", "2", "3"}


def plan_of(spark, files, answers, hot_rows=10**6):
    decisions = spark.createDataFrame(answers, "dedup_key string, answer string") if answers else None
    plan = cleanup.cleanup_plan(files, decisions, hot_rows=hot_rows)
    return plan, {r["path"]: r["action"] for r in plan.collect()}


def test_first_copy_stays(spark):
    files = keyed(spark, [("/b", 4, "k"), ("/a", 4, "k"), ("/c", 4, "k"), ("/u", 9, "u")])
    plan, actions = plan_of(spark, files, None)
    assert actions == {"/a": "keep", "/b": "trash", "/c": "trash"}
    assert tuple(cleanup.cleanup_summary(plan).collect()[0]) == (1, 2, 8)
    assert {r["target"] for r in plan.collect()} == {None, "b", "c"}
    unique = cleanup.unique_files(files)
    assert {r["path"] for r in unique.collect()} == {"/a", "/u"}


def test_answers(spark):
    keys = ["second", "skip", "far", "word", "blank", "none", "signed", "zero"]
    files = keyed(spark, [(f"/{k}/{i}", 2, k) for k in keys for i in (1, 2, 3)])
    answers = [
        ("second", " 2 "),
        ("skip", "S"),
        ("far", "99"),
        ("word", "x"),
        ("blank", ""),
        ("signed", "+3"),
        ("zero", "0"),
        ("unknown", "2"),
    ]
    for hot_rows in (1, 10**6):
        plan, actions = plan_of(spark, files, answers, hot_rows)
        kept = {path for path, action in actions.items() if action == "keep"}
        assert kept == {"/second/2", "/far/1", "/word/1", "/blank/1", "/none/1", "/signed/3", "/zero/1"}
        assert {path for path, action in actions.items() if action == "skip"} == {
            "/skip/1",
            "/skip/2",
            "/skip/3",
        }
        assert tuple(cleanup.cleanup_summary(plan).collect()[0]) == (7, 14, 28)


def test_keeping_a_far_copy_of_a_hot_group(spark, coalescing):
    rows = skewed_rows()
    hot = sorted(path for path, _, key in rows if key == "hot")
    files = keyed(spark, rows)
    _, actions = plan_of(spark, files, [("hot", "77")], hot_rows=20)
    assert [p for p in hot if actions[p] == "keep"] == [hot[76]]
    assert len(actions) == sum(map(len, by_key(rows).values()))


def test_colliding_targets(spark):
    files = keyed(spark, [("/0", 1, "k"), ("/a/b", 1, "k"), ("/a__b", 1, "k"), ("/c", 1, "k")])
    plan = cleanup.dedup_keep_first(files)
    assert [tuple(r) for r in cleanup.trash_collisions(plan).collect()] == [("a__b", 2, "/a/b", "/a__b")]
    apart = cleanup.separate_targets(plan)
    targets = [r["target"] for r in apart.collect() if r["target"]]
    assert len(targets) == len(set(targets)) == 3 and "c" in targets
    assert cleanup.trash_collisions(apart).count() == 0
