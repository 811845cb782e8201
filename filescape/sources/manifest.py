"""Cloud-drive listings: folders linked by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filescape.functions.labels import (
    DRIVE_ROOT_ID,
    DRIVE_ROOT_NAME,
    DRIVE_ROOT_WORDS,
    FOLDER_MIME,
)
from filescape.functions.names import drive_dedup_key, drive_ext, drive_type_label
from filescape.functions.sizes import modified_time
from filescape.operators.skew import HOT_ROWS, attach
from filescape.schema import MANIFEST
from filescape.session import cut, free


def read_manifest(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A listing stored as parquet, json or csv, without its trashed rows."""
    return manifest_source(spark.read.schema(MANIFEST).format(format).load(path))


def manifest_source(listing: DataFrame) -> DataFrame:
    """Rows of a listing that are not in the trash."""
    return listing.where(~F.coalesce("trashed", F.lit(False)))


def folder_candidates(listing: DataFrame, name: str) -> DataFrame:
    """All folders of a name that are not in the trash."""
    return manifest_source(listing).where((F.col("mime_type") == FOLDER_MIME) & (F.col("name") == name))


def resolve_folder(
    listing: DataFrame, target: str = "", explicit_id: str | None = None
) -> tuple[str, str]:
    """Id and display name of the folder meant by a name or an id.

    No name, "root" and "my drive" mean the root. ValueError when nothing, no folder or
    more than one folder fits.
    """
    is_folder = F.col("mime_type") == FOLDER_MIME
    if explicit_id == DRIVE_ROOT_ID:
        return DRIVE_ROOT_ID, DRIVE_ROOT_NAME
    if explicit_id:
        hits = listing.where(F.col("id") == explicit_id).select("id", "name", is_folder).take(1)
        if not hits:
            raise ValueError(f"no folder with id {explicit_id!r}")
        if not hits[0][2]:
            raise ValueError(f"{explicit_id!r} is not a folder")
        return hits[0][0], hits[0][1]
    if target.lower() in DRIVE_ROOT_WORDS:
        return DRIVE_ROOT_ID, DRIVE_ROOT_NAME
    hits = folder_candidates(listing, target).select("id").take(2)
    if not hits:
        raise ValueError(f"no folder named {target!r}")
    if len(hits) > 1:
        raise ValueError(f"several folders named {target!r}, pick one of folder_candidates by its id")
    return hits[0][0], target


def _climb(folders: DataFrame, root_id: str, hot_rows: int) -> DataFrame:
    """(id, path, ids) of the folders below the root, path and ids from below the root on.

    Every folder holds a pointer `up` and the way from below it to the folder. In a round
    each takes over the pointer of the folder it points to and puts that one's way before
    its own, so a way doubles, and depth d takes log2(d) rounds and one more. Folders
    whose pointer leads nowhere, or whose way meets itself, drop out.
    """
    state = cut(folders.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.array("id").alias("ids")))
    while True:
        climbing = state.where(F.col("up") != root_id)
        if climbing.isEmpty():
            return state.where(F.col("up") == root_id).select("id", "path", "ids")
        asked = climbing.groupBy("up").agg(F.count("*").alias("_n"))
        higher = state.select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("ids").alias("_ids")
        )
        met = attach(climbing, higher.join(asked, "up"), "up", "_n", "id", "inner", hot_rows)
        moved = met.select(
            "id",
            F.col("_up").alias("up"),
            F.concat("_path", F.lit("/"), "path").alias("path"),
            F.concat("_ids", "ids").alias("ids"),
        ).where(F.size(F.array_distinct("ids")) == F.size("ids"))
        before, state = state, cut(state.where(F.col("up") == root_id).unionByName(moved))
        free(before)


def manifest_nodes(
    listing: DataFrame,
    target: str = "",
    explicit_id: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Files and folders below a folder, with their paths.

    Paths start with the folder's name. Rows not reached from it through live folders are
    left out. Folders find their way up by pointer doubling; files are joined to their
    folder once, at the end.
    """
    root_id, root_name = resolve_folder(listing, target, explicit_id)
    live = manifest_source(listing).where(F.col("id") != root_id)
    is_folder = F.coalesce(F.col("mime_type") == FOLDER_MIME, F.lit(False))
    zero = F.lit(0).cast("bigint")
    children = live.groupBy("parent_id").agg(F.count("*").alias("_n"))
    top = listing.sparkSession.createDataFrame([(root_id, root_name)], "parent string, above string")
    below = _climb(live.where(is_folder), root_id, hot_rows).select(
        F.col("id").alias("parent"),
        F.concat(F.lit(f"{root_name}/"), "path").alias("above"),
        F.concat(F.array(F.lit(root_id)), "ids").alias("ancestor_ids"),
    )
    placed = top.withColumn("ancestor_ids", F.array("parent")).unionByName(below)
    parents = placed.join(children, F.col("parent") == F.col("parent_id")).drop("parent_id")
    found = attach(
        live.withColumnRenamed("parent_id", "parent"), parents, "parent", "_n", "id", "inner", hot_rows
    )
    mtime = modified_time("modified_time") if "modified_time" in listing.columns else F.lit(None)
    return found.select(
        "id",
        "parent",
        F.concat("above", F.lit("/"), "name").alias("path"),
        "name",
        is_folder.alias("is_dir"),
        F.lit(False).alias("is_symlink"),
        F.coalesce("size", zero).alias("size"),
        mtime.cast("timestamp").alias("mtime"),
        "mime_type",
        F.col("md5").alias("checksum"),
        drive_ext("name", "mime_type").alias("ext"),
        drive_type_label("name", "mime_type").alias("type_label"),
        drive_dedup_key("name", F.coalesce("size", zero), "md5").alias("dedup_key"),
        "ancestor_ids",
    )


def manifest_files(nodes: DataFrame) -> DataFrame:
    """The rows of `manifest_nodes` that are no folders."""
    return nodes.where(~F.col("is_dir"))
