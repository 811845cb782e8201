"""Duplicate clean-up as a plan: which copy stays, which go to the trash folder and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescape.functions.names import trash_name
from filescape.operators.dedup import group_by_key
from filescape.operators.ranking import rank_within
from filescape.operators.skew import HOT_ROWS, attach
from filescape.session import cut


def _members(files: DataFrame, key: str) -> DataFrame:
    ident = F.col("id") if "id" in files.columns else F.col("path")
    return files.select(F.col(key).alias("dedup_key"), ident.alias("id"), "path", "size").where(
        "dedup_key is not null"
    )


def _answer(answer: Column, copies: Column) -> tuple[Column, Column]:
    """Skip flag and number of the copy to keep; anything not understood keeps copy 1."""
    text = F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text).try_cast("bigint")
    keep = F.when(number.between(F.lit(1), copies), number).otherwise(1)
    return F.coalesce(text.isin("s", "S"), F.lit(False)), keep


def cleanup_plan(
    files: DataFrame,
    decisions: DataFrame | None = None,
    key: str = "dedup_key",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per copy: dedup_key, id, path, size, action and target.

    `decisions` (dedup_key, answer) holds the number of the copy to keep, counted by path,
    or s to leave a group alone; without an answer the first copy stays. The action is
    keep, trash or skip, the target the name inside the trash folder. Only groups whose
    answer is another copy than the first are numbered.
    """
    files = cut(_members(files, key))
    groups = group_by_key(files).where("copies >= 2")
    if decisions is None:
        chosen = groups.select(
            "dedup_key", "copies", F.lit(False).alias("skip"), F.col("first_id").alias("keeper")
        )
    else:
        answers = decisions.groupBy("dedup_key").agg(F.min("answer").alias("answer"))
        skip, keep = _answer(F.col("answer"), F.col("copies"))
        answered = cut(
            groups.join(answers, "dedup_key", "left").select(
                "dedup_key", "copies", "first_id", skip.alias("skip"), keep.alias("keep")
            )
        )
        later = answered.where((F.col("keep") > 1) & ~F.col("skip"))
        numbered = rank_within(
            attach(
                files, later.drop("first_id", "skip"), "dedup_key", "copies", "id", "inner", hot_rows
            ),
            ["dedup_key"],
            ["path", "id"],
        )
        others = numbered.where("rank = keep").select("dedup_key", F.col("id").alias("other"))
        chosen = answered.join(others, "dedup_key", "left").select(
            "dedup_key", "copies", "skip", F.coalesce("other", "first_id").alias("keeper")
        )
    planned = attach(files, chosen, "dedup_key", "copies", "id", "inner", hot_rows)
    action = (
        F.when(F.col("skip"), F.lit("skip"))
        .when(F.col("id") == F.col("keeper"), F.lit("keep"))
        .otherwise(F.lit("trash"))
    )
    return planned.withColumn("action", action).select(
        "dedup_key",
        "id",
        "path",
        "size",
        "action",
        F.when(F.col("action") == "trash", trash_name("path")).alias("target"),
    )


def dedup_keep_first(
    files: DataFrame, key: str = "dedup_key", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The plan without answers: the first copy by path stays."""
    return cleanup_plan(files, None, key, hot_rows)


def cleanup_summary(plan: DataFrame) -> DataFrame:
    """One row: groups handled, files moved and bytes freed."""
    moved = F.col("action") == "trash"
    return plan.agg(
        F.count_if(F.col("action") == "keep").alias("groups_handled"),
        F.count_if(moved).alias("files_moved"),
        F.coalesce(F.sum(F.when(moved, F.col("size"))), F.lit(0)).alias("bytes_freed"),
    )


def trash_collisions(plan: DataFrame) -> DataFrame:
    """(target, files, first_path, last_path): targets more than one file would be moved to."""
    return (
        plan.where("target is not null")
        .groupBy("target")
        .agg(
            F.count("*").alias("files"),
            F.min("path").alias("first_path"),
            F.max("path").alias("last_path"),
        )
        .where("files > 1")
    )


def separate_targets(plan: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The plan with a hash of the path added to targets that would collide."""
    plan = cut(plan)
    clashes = trash_collisions(plan).select("target", "files", F.lit(True).alias("_clash"))
    marked = attach(plan, clashes, "target", "files", "id", hot_rows=hot_rows)
    apart = F.concat("target", F.lit("~"), F.sha2("id", 256))
    target = F.when(F.col("_clash"), apart).otherwise(F.col("target"))
    return marked.withColumn("target", target).drop("_clash")


def unique_files(files: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row per distinct content: the first copy by path, and every file without a key."""
    # the group of files without a key holds no copies of a key
    first = group_by_key(files, key).where("copies >= 1").select(
        "dedup_key", F.col("first_id").alias("id"), F.col("first_path").alias("path"), "size"
    )
    ident = F.col("id") if "id" in files.columns else F.col("path")
    unkeyed = files.where(F.col(key).isNull()).select(
        F.lit(None).cast("string").alias("dedup_key"), ident.alias("id"), "path", "size"
    )
    return first.unionByName(unkeyed)
