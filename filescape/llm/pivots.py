"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points, the pivots. Vectors that are
alike have most of them in common, so a pair is looked at when at least `shared` of its
`near` nearest pivots are the same. Pivots are put in one order, rarest first; then such a
pair already meets in the inverted list of one of the first near - shared + 1 pivots of
both, and only these are listed. A pair is counted in the first list it meets in, and
verified with the cosine in double precision.

The pivots are `pivots` points chosen from a sample of at most `sample` vectors, each as
far as possible from those chosen before; all vectors are listed. A long list is cut into
blocks, and every two blocks of it meet in a task of their own, which returns counts per
vector and one link to each vector's component there, never the pairs.

Only vectors with equal labels that are not null are compared. Vectors that are null or
zero, hold a null or a number that is not finite, or differ in length link with nothing.
Equal vectors of a label form a class that is compared once and counts as often as it has
rows. A row with a null id takes part; a component of nothing but null ids has a null id.
An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.llm.graph import components

COSINE = 0.98
PIVOTS, NEAR, SHARED, SAMPLE = 128, 12, 7, 4096
BLOCK = 1024
#: Pairs whose cosine is taken at once.
_VERIFIED = 1 << 16


def vector_classes(vectors: DataFrame, vec="vec_id", embedding="embedding", label="label") -> DataFrame:
    """(vec_id, class, size, label, embedding): class is null for vectors that link with nothing."""
    sound = (
        F.col("embedding").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(F.col(vec).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    return rows.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding")))


def choose_pivots(classes: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """At most `pivots` unit vectors of each length found in the sample."""
    rows = [np.array(row[0]) for row in classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("embedding").collect()]
    chosen = {}
    for width in {len(row) for row in rows}:
        points = np.stack([row / np.abs(row).max() for row in rows if len(row) == width])
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        order, nearest = [0], points @ points[0]
        while len(order) < min(pivots, len(points)):
            order.append(int(np.argmin(nearest)))
            nearest = np.maximum(nearest, points @ points[order[-1]])
        chosen[width] = points[order]
    return chosen


def permutations(classes: DataFrame, chosen: dict[int, np.ndarray], near: int) -> DataFrame:
    """Adds `top`, the numbers of the nearest pivots; vectors of a length that the sample
    does not hold get the single number -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat, ends = column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
            widths = np.diff(ends)
            top: list = [[-1]] * len(widths)
            for width in set(widths.tolist()) & set(chosen):
                rows = np.flatnonzero(widths == width)
                values = flat[ends[rows][:, None] + np.arange(width)]
                nearest = np.argsort(-(values @ chosen[width].T), axis=1, kind="stable")[:, :near]
                for row, own in zip(rows.tolist(), nearest.tolist()):
                    top[row] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, pa.list_(pa.int32()))], [*batch.schema.names, "top"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in classes.dtypes)
    return classes.mapInArrow(run, schema + ", top array<int>")


def _meet(near: int, shared: int, cosine: float):
    """Counts and links of the vectors of one block with those of another, or of one block.

    Shared pivots are counted first; the cosine is taken of the pairs that have enough.
    """

    def run(table: pa.Table) -> pa.Table:
        rank = table.column("rank")[0].as_py()
        node, size = table.column("class").to_numpy(), table.column("size").to_numpy()
        points = np.stack(table.column("embedding").combine_chunks().to_numpy(zero_copy_only=False))
        points = points / np.abs(points).max(axis=1, keepdims=True)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        ranks = table.column("ranks").to_pylist()
        width = 1 + max(map(max, ranks))
        member = np.zeros((len(node), width), np.float32)
        listed = np.zeros((len(node), width), np.float32)
        for row, own in enumerate(ranks):
            member[row, own] = 1
            listed[row, own[: max(1, len(own) - shared + 1)]] = 1
        needed = np.array([min(shared, len(own)) for own in ranks], np.float32)
        before = listed[:, :rank]
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        side = table.column("side").to_numpy()
        left = np.arange(len(node)) if one else np.flatnonzero(side == 1)
        right = left if one else np.flatnonzero(side == 0)
        candidate = member[left] @ member[right].T >= np.minimum(needed[left][:, None], needed[right][None, :])
        candidate &= before[left] @ before[right].T == 0
        if one:
            candidate = np.triu(candidate, 1)
        a, b = np.nonzero(candidate)
        a, b = left[a], right[b]
        linked = np.zeros(len(a), bool)
        for at in range(0, len(a), _VERIFIED):
            own = slice(at, at + _VERIFIED)
            linked[own] = np.einsum("ij,ij->i", points[a[own]], points[b[own]]) >= cosine
        a, b = a[linked], b[linked]
        links = np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node))
        label = node.copy()
        while True:
            lower = label.copy()
            np.minimum.at(lower, a, label[b])
            np.minimum.at(lower, b, label[a])
            if (lower == label).all():
                break
            label = lower
        some = links > 0
        return pa.table({"class": node[some], "root": label[some], "links": links[some].astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, cut, vec="vec_id", embedding="embedding", label="label", cosine: float = COSINE,
                 pivots: int = PIVOTS, near: int = NEAR, shared: int = SHARED, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row. `cut` writes a frame that is read again."""
    rows = cut(vector_classes(vectors, vec, embedding, label))
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.count("*").alias("size"), F.min("vec_id").alias("smallest"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = cut(classes)
    found = cut(permutations(classes, choose_pivots(classes, pivots, sample), near))
    met = cut(_met(found, near, shared, cosine, block))
    groups = components(met.select(F.col("class").alias("a"), F.col("root").alias("b")), cut)
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    known = (
        classes.select("class", "size", "smallest").join(links, "class", "left").join(groups, F.col("class") == F.col("node"), "left")
        .withColumn("_group", F.coalesce("component", "class"))
    )
    least = known.groupBy("_group").agg(F.min("smallest").alias("component_id"))
    told = known.join(least, "_group").select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = rows.filter("class is not null").select("vec_id", "class").join(told, "class").select("vec_id", "n_links", "component_id")
    alone = rows.filter("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionAll(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _met(found: DataFrame, near: int, shared: int, cosine: float, block: int) -> DataFrame:
    often = {row[0]: row[1] for row in found.select(F.explode("top").alias("p")).groupBy("p").count().collect()}
    place = {pivot: rank for rank, pivot in enumerate(sorted(often, key=lambda p: (often[p], p)))}
    ranks = F.array(*[F.lit(place.get(p, 0)) for p in range(-1, max([*often, 0]) + 1)])
    ranked = found.select(
        "class", "size", "label", F.size("embedding").alias("width"), "embedding",
        F.sort_array(F.transform("top", lambda p: F.get(ranks, p + 1))).alias("ranks"),
    )
    prefix = F.slice("ranks", 1, F.greatest(F.size("ranks") - shared + 1, F.lit(1)))
    lists = ranked.withColumn("rank", F.explode(prefix))
    keys = ["label", "width", "rank"]
    sizes = lists.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = lists.join(sizes, keys).withColumn("b", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        *keys, "class", "size", "embedding", "ranks", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"),
        (F.col("b") <= F.col("other")).cast("int").alias("side"),
    )
    return paired.groupBy(*keys, "i", "j").applyInArrow(_meet(near, shared, cosine), "class bigint, root bigint, links bigint")
