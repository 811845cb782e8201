"""Mining of naming templates such as ``report_{1}_{2}.pdf``.

Names are grouped by extension and shape, then a group is split on the leftmost varying
segment whose every value covers enough files, and so on inside the parts. All groups of
a round are split together: one round is a fixed number of aggregations and one join over
the names still undecided, however many groups there are and however large one of them is.
Files with one name count as one name with their number. A split fixes one more segment, so
there are at most as many rounds as a name has letter and digit runs, and segments that are
constant in a group are not looked at again in its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescape.functions.names import name_stem, segment_kind, segment_values, shape_key
from filescape.operators.scope import with_ext
from filescape.operators.skew import HOT_ROWS, attach
from filescape.session import cut, free

DEFAULT_MIN_GROUP = 2
#: Groups of all rounds that are sent to all tasks; with more, files are dealt by name instead.
SENT_GROUPS = 50_000


def _least(min_group: int) -> int:
    return min_group if min_group > 0 else DEFAULT_MIN_GROUP


def _stems(files: DataFrame, fold_ext_case: bool = False) -> DataFrame:
    """(path, ext, stem, shape) of every file."""
    stem = name_stem("name", "ext", fold_ext_case)
    return (
        with_ext(files)
        .select("path", "ext", stem.alias("stem"))
        .withColumn("shape", shape_key("stem"))
    )


def pattern_buckets(files: DataFrame, min_group: int = DEFAULT_MIN_GROUP) -> DataFrame:
    """(ext, shape, count) of the name shapes with enough files."""
    stem = name_stem("name", "ext")
    return (
        with_ext(files)
        .groupBy("ext", shape_key(stem).alias("shape"))
        .agg(F.count("*").alias("count"))
        .where(F.col("count") >= _least(min_group))
    )


def _position_stats(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and segment position: distinct values, files of the rarest value, files.

    Files are first counted per value, partly on the map side, so a group holding most
    files is spread over its values.
    """
    exploded = files.select(*keys, F.posexplode(segment_values("stem")).alias("pos", "value"))
    per_value = (
        exploded.where(segment_kind(F.col("value")) != "S")
        .groupBy(*keys, "pos", "value")
        .agg(F.count("*").alias("files"))
    )
    return per_value.groupBy(*keys, "pos").agg(
        F.count("*").alias("n_values"),
        F.min("files").alias("rarest"),
        F.sum("files").alias("files"),
    )


def _bucket_stats(files: DataFrame, min_group: int) -> DataFrame:
    stats = _position_stats(_stems(files), ["ext", "shape"])
    return stats.where((F.col("files") >= _least(min_group)) & (F.col("n_values") >= 2))


def varying_positions(files: DataFrame, min_group: int = DEFAULT_MIN_GROUP) -> DataFrame:
    """(ext, shape, pos, n_values): segment positions with two or more values per bucket."""
    return _bucket_stats(files, min_group).select("ext", "shape", "pos", "n_values")


def split_position(files: DataFrame, min_group: int = DEFAULT_MIN_GROUP) -> DataFrame:
    """(ext, shape, pos): where each bucket is split first, for the buckets that are."""
    clean = _bucket_stats(files, min_group).where(F.col("rarest") >= _least(min_group))
    return clean.groupBy("ext", "shape").agg(F.min("pos").alias("pos"))


def _named(files: DataFrame, fold_ext_case: bool) -> DataFrame:
    """(path, ext, stem) of every file, written once. The narrow rows are spread before names
    are taken apart, whatever few splits the listing came in."""
    columns = [c for c in ("path", "name", "ext") if c in files.columns]
    spread = with_ext(files.select(*columns).repartition("path"))
    return cut(spread.select("path", "ext", name_stem("name", "ext", fold_ext_case).alias("stem")))


def _in_word(value: Column) -> Column:
    first = F.ascii(value)
    return first.between(48, 57) | first.between(65, 90) | first.between(97, 122)


def _shape(segments: Column) -> Column:
    """`shape_key` of the stem with these segments, which are at hand."""

    def piece(value: Column) -> Column:
        return F.when(_in_word(value), F.when(F.ascii(value) < 58, F.lit("D")).otherwise(F.lit("A"))).otherwise(value)

    return F.array_join(F.transform(segments, piece), "")


def _classes(named: DataFrame) -> DataFrame:
    """One row per different name: ext, stem, n (files), parent and part (its group), and in
    `rest` the letter and digit segments that may still vary in the group."""
    segments = F.transform("segs", lambda value, at: F.struct(at.alias("pos"), value.alias("value")))
    return (
        named.groupBy("ext", "stem")
        .agg(F.count("*").alias("n"))
        .withColumn("segs", segment_values("stem"))
        .select(
            "ext",
            "stem",
            "n",
            F.concat("ext", F.lit("|"), _shape(F.col("segs"))).alias("parent"),
            F.lit("").alias("part"),
            F.filter(segments, lambda s: _in_word(s["value"])).alias("rest"),
        )
    )


def _decisions(active: DataFrame, least: int) -> DataFrame:
    """Per group: files, varying positions and the position to split at, if any.

    Groups too small or without a varying position are left out. Names are counted with
    the number of files they stand for.
    """
    varies = F.col("n_values") >= 2
    clean = varies & (F.col("rarest") >= least)
    group = ["parent", "part"]
    per_value = (
        active.select(*group, "n", F.inline("rest"))
        .groupBy(*group, "pos", "value")
        .agg(F.sum("n").alias("files"), F.count("*").alias("names"))
    )
    per_position = per_value.groupBy(*group, "pos").agg(
        F.count("*").alias("n_values"),
        F.min("files").alias("rarest"),
        F.sum("files").alias("files"),
        F.sum("names").alias("_n"),
    )
    return (
        per_position.groupBy(*group)
        .agg(
            F.max("files").alias("files"),
            F.max("_n").alias("_n"),
            F.min(F.when(clean, F.col("pos"))).alias("split"),
            F.sort_array(F.collect_list(F.when(varies, F.col("pos")))).alias("varying"),
        )
        .where((F.col("files") >= least) & (F.size("varying") > 0))
    )


def _named_groups(decisions: DataFrame, above: DataFrame | None, round_: int) -> DataFrame:
    """Adds an id, unique over all rounds, and `group_key`, the shape and the splits that led here."""
    numbered = decisions.withColumn(
        "id", F.concat(F.lit(f"{round_}:"), F.monotonically_increasing_id().cast("string"))
    )
    if above is None:
        return numbered.withColumn("group_key", F.col("parent"))
    parents = above.select(
        F.col("id").alias("parent"), F.col("group_key").alias("_above"), F.col("split").alias("_at")
    )
    step = F.concat("_above", F.lit("|"), F.col("_at").cast("string"), F.lit("="), "part")
    return numbered.join(parents, "parent").withColumn("group_key", step).drop("_above", "_at")


def _tree(classes: DataFrame, least: int, hot_rows: int) -> list[DataFrame]:
    """The decisions of every round, each written on its own.

    A round reads the names of groups that were split, less the segments found constant, and
    writes no more of them than their number and the segments that may still vary.
    """
    active, tree = classes.select("n", "parent", "part", "rest"), []
    while True:
        above = tree[-1] if tree else None
        tree.append(cut(_named_groups(_decisions(active, least), above, len(tree))))
        split = tree[-1].where("split is not null").select("parent", "part", "_n", "id", "split", "varying")
        if split.isEmpty():
            free(active)
            return tree
        decided = attach(active, split, ["parent", "part"], "_n", "rest", "inner", hot_rows)
        at = F.filter("rest", lambda s: s["pos"] == F.col("split"))
        rest = F.filter(
            "rest", lambda s: (s["pos"] != F.col("split")) & F.array_contains("varying", s["pos"])
        )
        below = cut(decided.select("n", F.col("id").alias("parent"), at[0]["value"].alias("part"), rest.alias("rest")))
        free(active)
        active = below


def _led(rows: DataFrame, tree: list[DataFrame], join) -> DataFrame:
    """Rows with a name (ext, stem), its segments `segs` and their final group: group_key, files,
    varying. `join` adds the decisions of a round to rows with parent and part."""
    kept = [*rows.columns, "segs"]
    led = rows.withColumn("segs", segment_values("stem")).withColumns({
        "parent": F.concat("ext", F.lit("|"), _shape(F.col("segs"))),
        "part": F.lit(""),
        "leaf": F.lit(None).cast("struct<group_key: string, files: bigint, varying: array<int>>"),
    })
    for decisions in tree:
        met = join(led, decisions.select("parent", "part", "_n", "id", "split", "group_key", "files", "varying"))
        ended = F.col("id").isNotNull() & F.col("split").isNull()
        led = met.select(
            *kept,
            F.when(F.col("split").isNotNull(), F.col("id")).alias("parent"),
            F.get("segs", F.col("split")).alias("part"),
            F.when(ended, F.struct("group_key", "files", "varying")).otherwise(F.col("leaf")).alias("leaf"),
        )
    return led.where("leaf is not null").select(*kept, "leaf.*")


def refined_names(
    named: DataFrame, min_group: int = DEFAULT_MIN_GROUP, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Different names with their final group: ext, stem, n, group_key, files, varying.

    Rounds run on different names, each with its number of files. The decisions of a round
    are written out on their own, so that the planner knows their size and leaves the
    names where they are while the decisions are small.
    """
    classes = cut(_classes(named))
    return _led_names(classes, _tree(classes, _least(min_group), hot_rows), hot_rows)


def _led_names(classes: DataFrame, tree: list[DataFrame], hot_rows: int) -> DataFrame:
    led = _led(
        classes.select("ext", "stem", "n"),
        tree,
        lambda rows, decisions: attach(rows, decisions, ["parent", "part"], "_n", "stem", "left", hot_rows),
    )
    return led.drop("segs")


def _grouped_files(
    files: DataFrame, min_group: int, hot_rows: int, fold_ext_case: bool, sent_groups: int = SENT_GROUPS
) -> DataFrame:
    """`refined_files` with `segs`, the segments of the stem."""
    named = _named(files, fold_ext_case)
    classes = cut(_classes(named))
    tree = _tree(classes, _least(min_group), hot_rows)
    if sum(decisions.count() for decisions in tree) <= sent_groups:
        free(classes)
        return _led(
            named,
            tree,
            lambda rows, decisions: rows.join(F.broadcast(decisions.drop("_n")), ["parent", "part"], "left"),
        )
    groups = _led_names(classes, tree, hot_rows)
    found = attach(named, groups, ["ext", "stem"], "n", "path", "inner", hot_rows)
    return found.withColumn("segs", segment_values("stem"))


def refined_files(
    files: DataFrame,
    min_group: int = DEFAULT_MIN_GROUP,
    hot_rows: int = HOT_ROWS,
    fold_ext_case: bool = False,
) -> DataFrame:
    """Files with the final group each belongs to.

    Columns: path, ext, stem, group_key, files (in the group), varying (positions). While all
    groups together are at most `SENT_GROUPS`, their decisions go to the files, which stay
    where they are; beyond that files shuffle once, by name, when their group is known.
    """
    return _grouped_files(files, min_group, hot_rows, fold_ext_case).drop("segs")


def _template(segments: Column) -> Column:
    """Constant segments and numbered slots, from the columns of `refined_files`."""

    def piece(value: Column, at: Column) -> Column:
        number = F.array_position("varying", at)
        slot = F.concat(F.lit("{"), number.cast("string"), F.lit("}"))
        return F.when(number > 0, slot).otherwise(value)

    return F.concat(F.array_join(F.transform(segments, piece), ""), "ext")


def refine_patterns(
    files: DataFrame, min_group: int = DEFAULT_MIN_GROUP, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per final group: group_key, template, count."""
    refined = refined_names(_named(files, False), min_group, hot_rows)
    # All names of a group have one template, so it can be a grouping key.
    return refined.groupBy("group_key", _template(segment_values("stem")).alias("template")).agg(F.sum("n").alias("count"))


def name_patterns(
    files: DataFrame,
    min_group: int = DEFAULT_MIN_GROUP,
    hot_rows: int = HOT_ROWS,
    fold_ext_case: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """One row per file that follows a template.

    Columns: group_key, template, count, path, fields. Ordered by count, largest first,
    then template and path.
    """
    found = _grouped_files(files, min_group, hot_rows, fold_ext_case).select(
        "group_key",
        _template(F.col("segs")).alias("template"),
        F.col("files").alias("count"),
        "path",
        F.transform("varying", lambda at: F.get("segs", at)).alias("fields"),
    )
    # written, so that sampling for the order does not take the names apart a second time
    return cut(found).orderBy(F.desc("count"), "template", "path") if ordered else found
