"""N-gram Jaccard join by adaptive multi-match prefixes.

Every document is its set of distinct word shingles (64-bit hashes). Two sets with a
Jaccard similarity of t or more share at least ceil(t * n) shingles of either, so in one
order of all shingles, the first n - ceil(t * n) + m of both share at least m. Each
document picks its own m from the cost of its prefixes, measured by the lengths of the
shingles' posting lists: a longer prefix reads more postings, but then m shared ones are
required, or ceil(t * n) where a short text has to share fewer, and fewer pairs are
verified. Verification counts shared shingles exactly.

The order puts shingles counted as frequent last, by their count, and the others by hash.
The counts come from all documents. How many shingles are treated as frequent is bounded by
`frequent`, since they are sent to all tasks; any choice gives the same links, as long as
it is one order for all.

Equal sets form a class and are compared once. Before pairs are enumerated, every posting
list is compared with one of its members and what links is merged, round after round while
that links many; pairs are enumerated only where a list still holds different components,
so a group of copies costs few comparisons per member.

A null or empty text, or one without words, has no shingles and links with nothing; with
fewer words than a shingle the whole sequence is the one shingle. Rows with equal ids and
texts fall into one class; rows with a null id are linked like others, and a component of
nothing but null ids has a null id. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.llm.graph import components
from filescape.llm.tables import slices, tidied
from filescape.llm.words import distinct_in_rows, mix, shingle_hashes

PERCENT, WORDS = 75, 5
MOST_MATCHES = 4
FREQUENT, FREQUENT_COUNT = 100_000, 16
_COUNTED = 2_000_000
#: Members of a posting list that meet at once, and of one component from which it can
#: dominate a list.
BLOCK, DOMINANT = 256, 64
#: Cost of verifying a pair, in postings read.
_VERIFY = 20


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, shingles per document, signature of each set)."""
    values, counts = distinct_in_rows(*shingle_hashes(batch.column("text"), words))
    row = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        sums, other = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        np.add.at(sums, row, mix(values ^ np.uint64(0x5851F42D4C957F2D)))
        np.bitwise_xor.at(other, row, mix(values + np.uint64(0x14057B7EF767814F)))
    return values, counts, mix(sums ^ mix(other + counts.astype(np.uint64))).view(np.int64)


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that a set similar to it shares at least."""
    return -(-n * percent // 100)


def describe(documents: DataFrame, doc="doc_id", text="text", words: int = WORDS) -> DataFrame:
    """Rows (doc_id, n, class) per document, and rows (shingle, count) for shingles that
    several documents of a run of documents share, told apart by `kind`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts, signs = _sets(part, words)
                held.append(values)
                size += len(values)
                yield _described(0, part.column("doc_id"), counts, signs)
                if size >= _COUNTED:
                    yield _shared(held)
                    held, size = [], 0
        if held:
            yield _shared(held)

    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), "kind int, doc_id bigint, n bigint, class bigint")


def _described(kind: int, first, n: np.ndarray, signs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), kind, np.int32)), first, pa.array(n.astype(np.int64)), pa.array(signs)], ["kind", "doc_id", "n", "class"]
    )


def _shared(held: list[np.ndarray]) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(held), return_counts=True)
    several = counts > 1
    return _described(1, pa.array(values[several].view(np.int64)), counts[several], np.zeros(several.sum(), np.int64))


def frequent_shingles(described: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of the most frequent ones, at most `most`."""
    counted = described.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_COUNT)
    rows = counted.orderBy(F.desc("n"), "doc_id").limit(most).collect()
    keys = np.array([row[0] for row in rows], np.int64).view(np.uint64)
    counts = np.array([row[1] for row in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix_postings(documents: DataFrame, frequent, doc="doc_id", text="text", words=WORDS, percent=PERCENT, matches=MOST_MATCHES):
    """(shingle, salt, class, n, rank): the first shingles of every set in the common order,
    as many as `matches` required ones need. Frequent shingles are salted."""
    keys, weights = (documents.sparkSession.sparkContext.broadcast(x) for x in frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = keys.value, weights.value
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts, signs = _sets(part, words)
                row = np.repeat(np.arange(len(counts)), counts)
                weight = np.zeros(len(values), np.int64)
                if len(known) and len(values):
                    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    weight = np.where(known[place] == values, count[place], 0)
                order = np.lexsort((values, weight, row))
                rank = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
                kept = rank <= np.repeat(counts - required(counts, percent) + matches, counts)
                values, weight, row, rank = values[order][kept], weight[order][kept], row[kept], rank[kept]
                salt = np.where(weight > 0, 1 + (signs[row] & 1023), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values.view(np.int64)), pa.array(salt), pa.array(signs[row]), pa.array(counts[row].astype(np.int32)), pa.array(rank.astype(np.int32))],
                    ["shingle", "salt", "class", "n", "rank"],
                )

    rows = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(tidied(run), "shingle bigint, salt bigint, class bigint, n int, rank int")


def _several_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and class: one per class, and none of shingles that one
    class has alone. Frequent shingles, spread by salt, are known to be shared."""
    before, pending = (None, None), None
    for batch in batches:
        key, group = batch.column("shingle").to_numpy(), batch.column("class").to_numpy()
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        if len(key) and before == (key[0], group[0]):
            fresh[0] = False
        rows = batch.filter(pa.array(fresh))
        if not rows.num_rows:
            continue
        key = rows.column("shingle").to_numpy()
        if pending is not None and pending.column("shingle")[0].as_py() == key[0]:
            yield pending
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        first[0] = before[0] != key[0]
        alone = first.copy()
        alone[:-1] &= key[:-1] != key[1:]
        alone &= rows.column("salt").to_numpy() == 0
        pending = rows.slice(len(key) - 1) if alone[-1] else None
        before = (key[-1], rows.column("class").to_numpy()[-1])
        yield rows.filter(pa.array(~alone))


def shared_postings(postings: DataFrame) -> DataFrame:
    """The postings of shingles that several classes have among their prefixes, one per class."""
    dealt = postings.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "class")
    return dealt.mapInArrow(_several_classes, postings.schema).drop("salt")


def with_matches(postings: DataFrame, percent: int = PERCENT, matches: int = MOST_MATCHES) -> DataFrame:
    """Adds `m`, the number of shared prefix shingles each class asks for, and `first`, the
    length of its prefix for one.

    With m matches, a class reads the postings of its longer prefix, and at most a m-th of
    these are pairs to verify.
    """
    lists = postings.groupBy("shingle").agg(F.count("*").alias("length"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    sized = postings.join(lists, "shingle").withColumn("first", first.cast("int"))
    read = [F.sum(F.when(F.col("rank") < F.col("first") + m, F.col("length"))).alias(f"r{m}") for m in range(1, matches + 1)]
    costs = sized.groupBy("class").agg(*read)
    cost = [F.struct((F.coalesce(f"r{m}", F.lit(0)) * (1 + _VERIFY / m)).alias("cost"), F.lit(m).alias("m")) for m in range(1, matches + 1)]
    best = costs.select(F.col("class"), (F.array_min(F.array(*cost))["m"]).alias("m"))
    return sized.drop("length").join(best, "class")


def class_sets(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(class, shingles) from (text, wanted), the class each text is read for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, counts, signs = _sets(part, words)
                kept = pa.array(signs == part.column("wanted").to_numpy())
                raw = values.astype("<u8").tobytes()
                ends = (np.concatenate([[0], np.cumsum(counts)]) * 8).astype(np.int32)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(signs), blobs], ["class", "shingles"]).filter(kept)

    return texts.select("text", "wanted").mapInArrow(tidied(run), "class bigint, shingles binary")


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for row, (one, other) in enumerate(zip(batch.column("left"), batch.column("right"))):
                x, y = (np.frombuffer(side.as_buffer(), "<u8") for side in (one, other))
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    kept[row] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) of classes those that are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(_verify(percent), "a bigint, b bigint")


def prefixes(postings: DataFrame) -> DataFrame:
    """(class, n, shared): the prefix shingles of each class that other classes have too."""
    return postings.groupBy("class").agg(F.first("n").cast("long").alias("n"), F.collect_list(F.struct("shingle", "rank")).alias("t")).select(
        "class", "n", F.col("t.shingle").alias("shared"), F.col("t.rank").alias("ranks")
    )


def plausible(pairs: DataFrame, prefix: DataFrame, percent: int = PERCENT, matches: int = MOST_MATCHES) -> DataFrame:
    """Pairs (a, b) that their prefixes do not rule out.

    Similar sets share `matches` shingles in their prefixes. What they share altogether is
    at most what their prefixes share and what is left of the set whose prefix ends first.
    """
    x = prefix.select(F.col("class").alias("a"), F.col("n").alias("nx"), F.col("shared").alias("sx"))
    y = prefix.select(F.col("class").alias("b"), F.col("n").alias("ny"), F.col("shared").alias("sy"))
    least = lambda n: F.ceil(F.col(n) * percent / 100)
    rest = lambda n: F.greatest(least(n) - matches, F.lit(0))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("found", F.size(F.array_intersect("sx", "sy")))
    needed = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
    return both.filter(
        (F.col("nx") * 100 >= F.col("ny") * percent)
        & (F.col("ny") * 100 >= F.col("nx") * percent)
        & (F.col("found") >= F.least(F.lit(matches), least("nx"), least("ny")))
        & (F.col("found") + F.greatest(rest("nx"), rest("ny")) >= needed)
    ).select("a", "b")


def similar_classes(postings: DataFrame, fetch, cut, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all classes that link with another one.

    `fetch` returns the sets of given classes; those a round needs for the first time are
    read from the texts then.
    """
    spark = postings.sparkSession
    tried = links = spark.createDataFrame([], "a bigint, b bigint")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    prefix = cut(prefixes(postings))
    sets: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut(plausible(pairs, prefix, percent))
        needed = pairs.select(F.col("a").alias("class")).unionAll(pairs.select("b")).distinct()
        for known in sets:
            needed = needed.join(known.select("class"), "class", "left_anti")
        needed = cut(needed)
        if not needed.isEmpty():
            sets.append(cut(fetch(needed)))
        whole = reduce(DataFrame.unionAll, sets, spark.createDataFrame([], "class bigint, shingles binary"))
        return cut(verified(pairs, whole, percent))

    turn = 0
    while True:
        # every list against one of its members, in each turn another one
        labelled = _labelled(postings.filter(F.col("rank") <= F.col("first")), labels)
        drawn = F.struct(F.xxhash64("class", F.lit(turn)).alias("draw"), "component", "class")
        heads = labelled.groupBy("shingle").agg(
            F.min(drawn).alias("head"), F.min("component").alias("low"), F.max("component").alias("other")
        ).filter("low < other")
        pairs = cut(
            labelled.join(heads, "shingle")
            .filter(F.col("component") != F.col("head.component"))
            .select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b"))
            .distinct()
            .join(tried, ["a", "b"], "left_anti")
        )
        found = linked(pairs)
        tried = cut(tried.unionAll(pairs))
        links = cut(links.unionAll(found))
        labels = cut(components(links, cut))
        turn += 1
        # what few links are left is left to the pairs
        if found.count() * 50 <= pairs.count():
            break
    rest = cut(_pairs(cut(_labelled(postings, labels)), prefix, cut, percent).join(tried, ["a", "b"], "left_anti"))
    return components(links.unionAll(linked(rest)), cut)


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    joined = postings.join(labels, F.col("class") == F.col("node"), "left")
    return joined.withColumn("component", F.coalesce("component", "class")).drop("node")


def _mixed_lists(postings: DataFrame) -> DataFrame:
    """Posting lists with more than one component, and the size of the largest one there."""
    counts = postings.groupBy("shingle", "component").count()
    return counts.groupBy("shingle").agg(
        F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("total"), F.count("*").alias("kinds")
    ).filter("kinds > 1").select(
        "shingle", F.col("top.component").alias("major"), F.col("top.count").alias("most"), "total",
        ((F.col("top.count") >= DOMINANT) & (F.col("top.count") * 2 >= F.col("total"))).alias("dominated"),
    )


def _pairs(postings: DataFrame, prefix: DataFrame, cut, percent: int = PERCENT) -> DataFrame:
    """Pairs of classes of different components that share as many prefix shingles as the
    more demanding of the two asks for, or as the larger has to share at all where that is less.

    A list that one component dominates is not paired row by row: see `_dominated_pairs`,
    which finds all pairs that share such a list.
    """
    lists = cut(_mixed_lists(postings))
    dominated = _dominated_pairs(postings, prefix, lists.filter("dominated"), percent)
    rows = postings.join(lists.filter("not dominated").select("shingle"), "shingle")
    x, y = rows.alias("x"), rows.alias("y")
    m = F.greatest("x.m", "y.m")
    similar_size = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    inside = (F.col("x.rank") < F.col("x.first") + m) & (F.col("y.rank") < F.col("y.first") + m)
    apart = (F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component"))
    joined = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & apart & similar_size & inside)
    least = F.ceil(F.greatest("x.n", "y.n") * percent / 100)
    found = joined.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(
        F.count("*").alias("shared"), F.max(m).alias("m"), F.max(least).alias("least")
    )
    return found.filter(F.col("shared") >= F.least("m", "least")).select("a", "b").unionAll(dominated).distinct()


def _dominated_pairs(postings: DataFrame, prefix: DataFrame, lists: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Plausible pairs of different components that share a list dominated by one component.

    What is not in the component meets the whole list, block by block, and only plausible
    pairs become rows. A pair counts in the first such list both are in.
    """
    blocks = lists.select(
        "shingle", "major", F.ceil((F.col("total") - F.col("most")) / block).cast("int").alias("minors"), F.ceil(F.col("most") / block).cast("int").alias("majors")
    )
    listed = postings.select("shingle", "class", "component", "m", "first").join(blocks, "shingle")
    own = listed.groupBy("class").agg(F.collect_list("shingle").alias("dominated"))
    rows = listed.join(prefix, "class").join(own, "class")
    minor = F.col("component") != F.col("major")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), F.when(minor, F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    # places: block of minors, the block it meets (majors from 0, minors from -1 down), side
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    of_minor = F.concat(
        F.transform(each("majors"), lambda j: place(F.col("own"), j, 0)),
        F.transform(F.filter(each("minors"), lambda j: j >= F.col("own")), lambda j: place(F.col("own"), -1 - j, 0)),
        F.transform(F.filter(each("minors"), lambda i: i <= F.col("own")), lambda i: place(i, -1 - F.col("own"), 1)),
    )
    of_major = F.transform(each("minors"), lambda i: place(i, F.col("own"), 1))
    dealt = rows.withColumn("at", F.explode(F.when(minor, of_minor).otherwise(of_major)))
    dealt = dealt.select("shingle", "at.i", "at.j", "at.side", "class", "component", "m", "first", "n", "shared", "ranks", "dominated")
    return dealt.groupBy("shingle", "i", "j").applyInArrow(_meet(percent), "a bigint, b bigint")


def _meet(percent: int, matches: int = MOST_MATCHES):
    def run(table: pa.Table) -> pa.Table:
        here = table.column("shingle")[0].as_py()
        side = table.column("side").to_numpy()
        node, group, m, first, n = (table.column(name).to_numpy() for name in ("class", "component", "m", "first", "n"))
        lists = table.column("shared").combine_chunks()
        count = lists.value_lengths().to_numpy()
        token, rank = lists.flatten().to_numpy(), table.column("ranks").combine_chunks().flatten().to_numpy()
        kinds, place = np.unique(token, return_inverse=True)
        owner = np.repeat(np.arange(len(node)), count)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return empty

        def shared(keep: np.ndarray) -> np.ndarray:
            member = np.zeros((len(node), len(kinds)), np.float32)
            member[owner[keep], place[keep]] = 1
            return member[left] @ member[right].T

        x, y = left[:, None], right[None, :]
        fits = (group[x] != group[y]) & (n[x] * 100 >= n[y] * percent) & (n[y] * 100 >= n[x] * percent)
        if table.column("j")[0].as_py() == -1 - table.column("i")[0].as_py():
            fits &= node[x] < node[y]
        before = np.isin(token, table.column("dominated").combine_chunks().flatten().to_numpy()) & (token < here)
        fits &= shared(before) == 0
        found = shared(np.ones(len(token), bool))
        least = required(n, percent)
        rest = np.maximum(least - matches, 0)
        fits &= found + np.maximum(rest[x], rest[y]) >= -(-(n[x] + n[y]) * percent // (100 + percent))
        asked = np.maximum(m[x], m[y])
        for level in np.unique(asked[fits]) if fits.any() else ():
            enough = shared(rank < first[owner] + level) >= np.minimum(level, np.minimum(least[x], least[y]))
            fits &= (asked != level) | enough
        one, other = np.nonzero(fits)
        return pa.table({"a": node[left[one]], "b": node[right[other]]})

    return run


def link_documents(documents: DataFrame, cut, doc="doc_id", text="text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of `documents`. `cut` writes a frame that is
    read again."""
    told = cut(describe(documents, doc, text, words))
    rows = told.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "class")
    frequent = frequent_shingles(told)
    shared = cut(shared_postings(prefix_postings(documents, frequent, doc, text, words, percent)))
    postings = cut(with_matches(shared, percent))
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("_first"))
    texts = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def fetch(some: DataFrame) -> DataFrame:
        wanted = classes.join(some, "class").select("_first", F.col("class").alias("wanted"))
        return class_sets(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_first"))), words)

    groups = similar_classes(postings, fetch, cut, percent)
    known = classes.join(groups, F.col("class") == F.col("node"), "left").withColumn("_group", F.coalesce("component", "class"))
    smallest = known.groupBy("_group").agg(F.min("_first").alias("component_id"))
    labels = known.join(smallest, "_group").select("class", "component_id")
    linked = rows.filter("n_shingles > 0").join(labels, "class").select("doc_id", "n_shingles", "component_id")
    return linked.unionAll(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
