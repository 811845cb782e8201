"""Exact top-k search: BM25 by block-max WAND, shard by shard.

Documents are dealt into cells, and a cell's documents pass by in shards. A shard's inverted
index keeps its documents in blocks of neighbours, and for every frequent term and block the
largest impact of the term there. Postings of rare terms are walked; their sum and the
weighted block maxima of the frequent terms bound the scores of a block. The blocks with the
highest bounds are scored first, then those whose bound reaches the k-th best score known,
from the shards before as well, so what is skipped cannot be among the best k. Blocks are
scored in single precision for many queries at once; what may be among the best k is scored
again in double precision. Document frequencies, the number of documents and their mean
length are those of all documents, so scores of different cells compare, and the best k of
all cells together are the best k.

The score is sum over terms of qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) /
(tf + k1 * (1 - b + b * length / mean length)) with words as terms, A-Z as a-z. Documents
without a word of the query are no results; equal scores are ranked by id, nulls last.

A null text has no words: it is no result and has none. Rows with equal ids are documents
of their own; queries that are equal in id and text are one. A query with a null id is
answered under it. An empty table or query set gives no rows. Other columns are not looked
at. Queries are taken in groups whose terms fit `query_bytes`, and a shard is indexed once
for every group. The work is queries times documents, however small a part is scored; rows
that leave the tasks and queries sent to them go with the number of cells, not of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filescape.llm.tables import lengths, slices, tidied
from filescape.llm.words import distinct_in_rows, word_hashes

K, K1, B = 10, 1.2, 0.75
SHARD_BYTES, QUERY_BYTES, CELL_BYTES = 12 << 20, 48 << 20, 256 << 20
BLOCK_DOCS, _BLOCKS_AT_ONCE = 64, 8
#: Queries scored together, terms that more than 1 of so many documents of a shard have at most, and numbers held.
_QUERIES_AT_ONCE, _DENSE_TERMS, _DENSE, _RARE = 256, 4096, 8 << 20, 50
#: Sums of up to 4,096 terms in single precision are off by less than a thousandth.
_ROOM = 2e-3
_WORDS_HELD = 4_000_000


def term_statistics(documents: DataFrame, text="text") -> DataFrame:
    """(term, df, words, docs) rows to be added up; term is null for the counts of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, words, docs = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            terms, df = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([*terms.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(df, 0)),
                    pa.array(np.append(np.zeros_like(df), words)), pa.array(np.append(np.zeros_like(df), docs)),
                ],
                ["term", "df", "words", "docs"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = word_hashes(part.column("text"))
                held.append(distinct_in_rows(hashes, counts)[0])
                size, words, docs = size + len(held[-1]), words + len(hashes), docs + len(counts)
                if size >= _WORDS_HELD:
                    yield flush()
                    held, size, words, docs = [], 0, 0, 0
        yield flush()

    return documents.select(F.col(text).alias("text")).mapInArrow(run, "term bigint, df bigint, words bigint, docs bigint")


def query_terms(queries: DataFrame, query="doc_id", text="text") -> DataFrame:
    """(query_id, body, term, qtf) of all words of all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = word_hashes(part.column("text"))
                row = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(fresh)
                own = pa.array(row[at])
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id").take(own), part.column("body").take(own), pa.array(hashes[at].view(np.int64)), pa.array(np.diff(np.append(at, len(row))))],
                    ["query_id", "body", "term", "qtf"],
                )

    rows = queries.select(F.col(query).alias("query_id"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")).dropDuplicates(["query_id", "body"])
    kind = queries.schema[query].dataType.simpleString()
    return rows.mapInArrow(run, f"query_id {kind}, body bigint, term bigint, qtf bigint")


def weighted_queries(terms: DataFrame, statistics: DataFrame, docs: int) -> DataFrame:
    """(query_id, body, terms, weights), terms in order."""
    df = statistics.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").select("query_id", "body", F.struct("term", (F.col("qtf") * idf).alias("weight")).alias("t"))
    sorted_terms = weighted.groupBy("query_id", "body").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return sorted_terms.select("query_id", "body", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))


class Shard:
    """The index of a shard for the terms of a group of queries."""

    def __init__(self, texts: list[pa.Array], vocabulary: np.ndarray, mean: float, k1: float, b: float):
        doc, term, tf, length = [], [], [], []
        first = 0
        while texts:
            for part in slices(pa.RecordBatch.from_arrays([texts.pop(0)], ["text"]), "text"):
                hashes, counts = word_hashes(part.column("text"))
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                code, often = np.unique(row[known] * max(len(vocabulary), 1) + place[known], return_counts=True)
                doc.append((code // max(len(vocabulary), 1) + first).astype(np.int32))
                term.append((code % max(len(vocabulary), 1)).astype(np.int32))
                tf.append(often.astype(np.int32))
                length.append(counts)
                first += len(counts)
        doc, term, tf, length = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (doc, term, tf, length))
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
        # documents with the same most frequent term lie next to each other
        main = np.zeros(first, np.int32)
        rising = np.argsort(tf, kind="stable")
        main[doc[rising]] = term[rising]
        order = np.argsort(main, kind="stable")
        place = np.empty(first, np.int32)
        place[order] = np.arange(first)
        del tf, rising
        self.rows, doc = order, place[doc]
        self.blocks = -(-first // BLOCK_DOCS)
        # by document: the terms of a document keep their order
        at = np.argsort(doc, kind="stable")
        self.term, self.impact = term[at], impact[at]
        self.doc_start = np.searchsorted(doc[at], np.arange(first + 1))
        # by term
        at = np.lexsort((doc, term))
        term, self.posted, self.posted_impact = term[at], doc[at], impact[at].astype(np.float32)
        del doc, impact, at
        self.term_start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        # impacts of frequent terms, block by block, and the largest of each block
        often = np.diff(self.term_start)
        room = min(_DENSE_TERMS, _DENSE // max(self.blocks * BLOCK_DOCS, 1))
        dense = np.argsort(-often, kind="stable")[:room]
        dense = dense[often[dense] * _RARE >= max(first, 1)]
        self.column = np.full(len(vocabulary), -1)
        self.column[dense] = np.arange(len(dense))
        self.dense = np.zeros((self.blocks, len(dense), BLOCK_DOCS), np.float32)
        column = self.column[term]
        filled = column >= 0
        self.dense[self.posted[filled] // BLOCK_DOCS, column[filled], self.posted[filled] % BLOCK_DOCS] = self.posted_impact[filled]
        self.largest = self.dense.max(axis=2, initial=0).T.copy()
        self.weight = np.zeros(max(len(vocabulary), 1))

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, least: np.ndarray) -> Iterator[list[tuple[int, float]]]:
        """For each query (terms, weights) the (row, score) of its best k, scores below its
        `least` left out; `ids` are the places of the rows in the order of ids."""
        if not self.blocks:
            yield from ([] for _ in queries)
            return
        at_once = max(1, min(_QUERIES_AT_ONCE, _DENSE // (self.blocks * BLOCK_DOCS)))
        for low in range(0, len(queries), at_once):
            own = queries[low : low + at_once]
            scores, reach = self._near_scores(own, k, least[low : low + at_once])
            for (terms, weights), score, near, floor in zip(own, scores, reach, least[low : low + at_once]):
                places = np.flatnonzero((score > 0) & (score * (1 + _ROOM) >= near))
                if len(places) > k:
                    score = score[places]
                    places = places[score * (1 + _ROOM) >= np.partition(score, len(score) - k)[-k] * (1 - _ROOM)]
                yield self._exact(terms, weights, places, ids, k, floor)

    def _near_scores(self, queries, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores in single precision by place, 0 in blocks that are left out, and what a
        score has to reach to be one of the best k."""
        n, places = len(queries), self.blocks * BLOCK_DOCS
        weight, rest = np.zeros((n, self.dense.shape[1]), np.float32), np.zeros((n, places), np.float32)
        for row, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            rare = column < 0
            weight[row, column[~rare]] = weights[~rare]
            at, count = _ranges(self.term_start[terms[rare]], self.term_start[terms[rare] + 1])
            if len(at):
                rest[row] = np.bincount(self.posted[at], np.repeat(weights[rare], count) * self.posted_impact[at], places)
        bound = weight @ self.largest + rest.reshape(n, self.blocks, BLOCK_DOCS).max(axis=2)
        scores, done = np.zeros((n, places), np.float32), bound <= 0

        def score(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)):
                rows, inside = np.flatnonzero(wanted[:, block]), slice(block * BLOCK_DOCS, (block + 1) * BLOCK_DOCS)
                scores[rows, inside] = rest[rows, inside] + weight[rows] @ self.dense[block]

        reach = least
        if not least.all():
            best = np.argsort(-bound, axis=1)[:, :_BLOCKS_AT_ONCE]
            first = np.zeros_like(done)
            np.put_along_axis(first, best, True, axis=1)
            first &= ~done
            score(first)
            done |= first
            seen = np.take_along_axis(scores.reshape(n, self.blocks, BLOCK_DOCS), best[:, :, None], axis=1).reshape(n, -1)
            if k <= seen.shape[1]:
                reach = np.maximum(least, np.partition(seen, seen.shape[1] - k, axis=1)[:, -k] * (1 - _ROOM))
        score(~done & (bound * (1 + _ROOM) >= reach[:, None]))
        return scores, reach

    def _exact(self, terms, weights, places: np.ndarray, ids: np.ndarray, k: int, least: float) -> list[tuple[int, float]]:
        self.weight[terms] = weights
        at, count = _ranges(self.doc_start[places], self.doc_start[places + 1])
        score = np.bincount(np.repeat(np.arange(len(places)), count), self.weight[self.term[at]] * self.impact[at], len(places))
        self.weight[terms] = 0
        good = np.flatnonzero((score > 0) & (score >= least))
        rows, score = self.rows[places[good]], score[good]
        kept = np.lexsort((ids[rows], -score))[:k]
        return list(zip(rows[kept].tolist(), score[kept].tolist()))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers from each start up to its end, how many each has)."""
    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


class _Cell:
    """A group of queries and the best documents found for each as shards pass by."""

    def __init__(self):
        self.asked, self.texts, self.own, self.held = [], [], [], 0

    def ask(self, rows: pa.RecordBatch) -> None:
        terms, weights = ([row.values.to_numpy() for row in rows.column(name)] for name in ("terms", "weights"))
        self.asked += zip(rows.column("query_id").to_pylist(), rows.column("body").to_pylist(), terms, weights)

    def take(self, rows: pa.RecordBatch) -> None:
        self.texts.append(rows.column("text"))
        self.own += rows.column("doc_id").to_pylist()
        self.held += int(lengths(rows.column("text")).sum())

    def search(self, mean: float, k: int, k1: float, b: float) -> None:
        texts, own, self.texts, self.own, self.held = self.texts, self.own, [], [], 0
        if not self.asked or not own:
            return
        if not hasattr(self, "vocabulary"):
            self.vocabulary = np.unique(np.concatenate([terms.view(np.uint64) for _, _, terms, _ in self.asked]))
            # copies, so that the batches they came in are given back
            self.queries = [(np.searchsorted(self.vocabulary, terms.view(np.uint64)).astype(np.int32), weights.copy()) for _, _, terms, weights in self.asked]
            self.asked = [(query, body) for query, body, _, _ in self.asked]
            self.found = [[] for _ in self.asked]
        shard = Shard(texts, self.vocabulary, mean, k1, b)
        keys = [(i is None, 0 if i is None else i) for i in own]
        ids = np.empty(len(own), np.int64)
        ids[sorted(range(len(own)), key=keys.__getitem__)] = np.arange(len(own))
        least = np.array([-found[-1][0] if len(found) == k else 0.0 for found in self.found])
        for at, best in enumerate(shard.best(self.queries, ids, k, least)):
            if best:
                self.found[at] = sorted(self.found[at] + [(-score, *keys[row]) for row, score in best])[:k]

    def results(self) -> Iterator[tuple]:
        for (query, body), found in zip(self.asked, getattr(self, "found", [])):
            for score, missing, doc in found:
                yield query, body, None if missing else doc, -score


def _search(mean: float, k: int, k1: float, b: float, shard_bytes: int, kinds):
    names = ["query_id", "body", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, current = _Cell(), None

        def finish() -> pa.RecordBatch:
            cell.search(mean, k, k1, b)
            columns = list(zip(*cell.results())) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = np.flatnonzero(np.diff(part)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
                if low == high:
                    continue
                if current is not None and part[low] != current:
                    yield finish()
                    cell = _Cell()
                current = part[low]
                rows = batch.slice(low, high - low)
                asked = int(np.searchsorted(rows.column("role").to_numpy(), 1))  # queries come first
                if asked:
                    cell.ask(rows.slice(0, asked))
                for piece in slices(rows.slice(asked), "text", max(shard_bytes // 8, 1)):
                    cell.take(piece)
                    if cell.held >= shard_bytes:
                        cell.search(mean, k, k1, b)
                    piece = None
            batch = rows = None  # given back before the next one comes
        if current is not None:
            yield finish()

    return run


def search(documents: DataFrame, queries: DataFrame, cut, doc="doc_id", text="text", k: int = K, k1: float = K1, b: float = B,
           shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(query_id, rank, doc_id, score): the best `k` documents of every query.

    `queries` has the same id and text columns; `cut` writes a frame that is read again.
    """
    statistics = cut(term_statistics(documents, text))
    words, docs = statistics.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    size = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    asked = cut(weighted_queries(query_terms(queries, doc, text), statistics, docs))
    bulk = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] * 16
    shards, groups = max(1, -(-size // shard_bytes)), max(1, -(-bulk // query_bytes))
    cells = max(min(shards, 4 * documents.sparkSession.sparkContext.defaultParallelism), -(-size // cell_bytes))
    kind = documents.schema[doc].dataType.simpleString()
    # cells meet every group of queries; in a task the queries come first, then the texts
    texts = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells)).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("role"), "doc_id", "text"
    )
    dealt = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.pmod(F.xxhash64("query_id", "body"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("role"), *asked.columns
    )
    both = dealt.unionByName(texts, allowMissingColumns=True).withColumn("part", F.col("cell") * groups + F.col("group")).drop("cell", "group")
    both = both.repartitionById(cells * groups, F.col("part")).sortWithinPartitions("part", "role")
    from pyspark.sql.pandas.types import to_arrow_type

    own = to_arrow_type(documents.schema[doc].dataType)
    found = both.mapInArrow(
        tidied(_search(words / docs if words else 1.0, k, k1, b, shard_bytes, [own, pa.int64(), own, pa.float64()])),
        f"query_id {kind}, body bigint, doc_id {kind}, score double",
    )
    best = Window.partitionBy("query_id", "body").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
