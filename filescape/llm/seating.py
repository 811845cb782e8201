"""Hierarchical Pitman-Yor language model over words.

Every word that precedes another is the context of a restaurant whose customers are the
words that follow it in the training texts, and every table of these restaurants is a
customer of the one parent they share, whose own parent is uniform over the vocabulary and
one unknown word. Seatings are sampled by Gibbs sweeps: the customers of a word in a
restaurant are seated anew given all other tables there. Predictive probabilities are
averaged over the samples and scored over whole texts; the end of a text is a token.

Texts are dealt into chunks by a hash of id and text, and a chunk exchanges packed arrays
with the tasks that hold the restaurants: its pairs of words with their counts go there,
counts and tables come back. A pair seen at most once in training is not sent where one of
its words is in no other chunk, held-out texts included: its customer sits alone, and only
the number of such tables goes to the context's restaurant. Chances come from hashes of pair
and sweep, so neither the dealing nor the order of rows changes a score. The restaurant of a
very common context is dealt out by the words that follow; its number of tables is then
scaled up from the part a task sees, and summed exactly for the predictions. While children
are seated, the parent gives word frequencies; its own tables are sampled from theirs.

A null text is empty and consists of its end. A null id counts as empty text for the
held-out rule. Rows with equal ids are scored as rows of their own. With no training text
every word has the unknown word's probability. An empty table gives no rows. Other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filescape.llm.words import mix, word_hashes
from filescape.session import free

DISCOUNT, STRENGTH = 0.75, 1.0
BURN_IN, SAMPLES = 2, 2
CHUNK_BYTES, BUCKET_BYTES, HOT_CONTEXT = 6 << 20, 12 << 20, 2_000_000
#: Buckets are seated in so many rounds, each of which has its share of the pairs on the way.
_ROUNDS = 4
END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, tokens per text); an end follows every text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    word = np.insert(words, ends, END)
    counts = counts + 1
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(counts) - counts] = START
    return before, word, counts


def chances(keys: np.ndarray, round_: int, step: int) -> np.ndarray:
    """A number between 0 and 1 for every key, another one for each round and step."""
    salt = mix(np.array([(round_ << 32) + step], np.uint64))
    return ((mix(keys ^ salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def seat(customers: np.ndarray, pull: np.ndarray, keys: np.ndarray, round_: int, discount: float) -> np.ndarray:
    """Tables of words with so many customers, seated one after the other.

    `pull` is the weight of a new table. Beyond 64 customers they are seated in runs that
    double, each with the chance its middle customer has; the new tables of a run follow a
    normal distribution, or are rounded up or down at random where that is too narrow.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    seated, step = 1, 0
    active = np.flatnonzero(customers > 1)
    while len(active):
        run = 1 if seated < 64 else seated // 2
        room = np.minimum(customers[active] - seated, run)
        old = np.maximum(seated + (room - 1) / 2 - discount * tables[active], 1e-9)
        chance = pull[active] / (pull[active] + old)
        drawn = chances(keys[active], round_, step)
        if run == 1:
            new = drawn < chance
        else:
            mean, spread = room * chance, np.sqrt(room * chance * (1 - chance))
            normal = np.sqrt(-2 * np.log(drawn)) * np.cos(2 * np.pi * chances(keys[active], round_, step + 1))
            new = np.clip(np.where(spread > 2, np.rint(mean + spread * normal), np.floor(mean + drawn)), 0, room)
        tables[active] += new
        seated, step = seated + run, step + 2
        active = active[customers[active] > seated]
    return tables


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def _word_counts(texts: pa.Table) -> pa.Table:
    column = texts.column("text").combine_chunks()
    _, word, counts = tokens(column)
    trained = np.repeat(~texts.column("held_out").to_numpy(), counts)
    kinds, place = _group(word)
    found = np.bincount(place, trained, len(kinds)).astype(np.int64)
    chunk = texts.column("chunk")[0].as_py()
    begun = int((~texts.column("held_out").to_numpy()).sum())
    # the start is a context, never a token
    return pa.table({
        "chunk": np.full(len(kinds) + 1, chunk, np.int64),
        "word": np.append(kinds, START).view(np.int64),
        "n": np.append(found, begun),
    })


def _pairs(texts: pa.Table, words: pa.Table):
    """The words of a chunk with their counts in all training texts and the order they were
    sorted by; its distinct pairs with their counts here, whether they are sent, and whether
    the word before occurs in this chunk alone; the pair of every token, and the tokens per
    text."""
    before, word, counts = tokens(texts.column("text").combine_chunks())
    kinds = words.column("word").to_numpy().view(np.uint64)
    order = np.argsort(kinds)
    kinds, total = kinds[order], words.column("count").to_numpy()[order]
    u, w = np.searchsorted(kinds, before), np.searchsorted(kinds, word)
    code = u.astype(np.int64) * len(kinds) + w
    pairs, place = _group(code)
    trained = np.repeat(~texts.column("held_out").to_numpy(), counts)
    n = np.bincount(place, trained, len(pairs)).astype(np.int64)
    u, w = pairs // len(kinds), pairs % len(kinds)
    here = words.column("chunks").to_numpy()[order] == 1
    return kinds, total, order, u, w, n, (n > 1) | ~(here[u] | here[w]), here[u], place, counts


def _packed(values: np.ndarray) -> bytes:
    """Counts as the narrowest whole numbers that hold them, behind a byte with their width."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(buffer) -> np.ndarray:
    width = np.frombuffer(buffer, np.uint8, 1)[0]
    return np.frombuffer(buffer, f"<u{width}", offset=1)


def _ask(buckets: int, hot: int):
    def run(key, texts: pa.Table, words: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "context", "contexts", "alone", "word", "words", "u", "w", "n", "role", "key", "tables"]
        rows: list[tuple] = []
        if texts.num_rows:
            kinds, total, _, u, w, n, sent, here, _, _ = _pairs(texts, words)
            chunk = texts.column("chunk")[0].as_py()
            deal = mix(kinds)[u]
            deal = np.where(total[u] >= hot, mix(deal ^ kinds[w]), deal) % np.uint64(buckets)
            # customers that sit alone, told to restaurants that have others
            lone = ~sent & (n == 1)
            busy = np.zeros(len(kinds), bool)
            busy[u[sent]] = True
            some = np.flatnonzero(sent | lone & (~here | busy[u]))
            some = some[np.argsort(deal[some], kind="stable")]
            edges = np.flatnonzero(np.diff(deal[some])) + 1
            for part in np.split(some, edges):
                if len(part):
                    us, ui = _group(u[part])
                    alone = np.bincount(ui[lone[part]], minlength=len(us))
                    own = sent[part]
                    ws, wi = _group(w[part[own]])
                    blobs = [kinds[us].tobytes(), _packed(total[us]), _packed(alone), kinds[ws].tobytes(), *map(_packed, (total[ws], ui[own], wi, n[part[own]]))]
                    rows.append((int(deal[part[0]]), chunk, *blobs, None, None, None))
            for role, ends in ((0, u), (1, w)):
                sums = np.bincount(ends[lone], minlength=len(kinds))
                own = np.flatnonzero(sums)
                rows += [(None,) * 10 + (role, k, t) for k, t in zip(kinds[own].view(np.int64).tolist(), sums[own].tolist())]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds_ = [pa.int32(), pa.int64()] + [pa.binary()] * 8 + [pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds_)], names=names)

    return run


_ASKED = ("bucket int, chunk bigint, context binary, contexts binary, alone binary, word binary, words binary, u binary, w binary, n binary, "
          "role int, key bigint, tables bigint")


def _seat_bucket(total_tokens: int, vocabulary: int):
    """Sample the restaurants of a bucket; answer every chunk's pairs with counts and tables."""

    def run(blobs: pa.Table) -> pa.Table:
        keys_of = lambda name, row: np.frombuffer(blobs.column(name)[row].as_buffer(), np.uint64)
        read = lambda name, row: _unpacked(blobs.column(name)[row].as_buffer()).astype(np.int64)
        contexts, words, parts = [], [], []
        order = np.argsort(blobs.column("chunk").to_numpy(), kind="stable").tolist()
        for row in order:
            us, ws = keys_of("context", row), keys_of("word", row)
            contexts.append((us, read("contexts", row), read("alone", row)))
            words.append((ws, read("words", row)))
            parts.append((us[read("u", row)], ws[read("w", row)], read("n", row)))
        context, at, own = np.unique(np.concatenate([c for c, _, _ in contexts]), return_index=True, return_inverse=True)
        customers = np.concatenate([n for _, n, _ in contexts])[at]
        alone = np.bincount(own, np.concatenate([n for _, _, n in contexts]), len(context))
        word, at = np.unique(np.concatenate([w for w, _ in words]), return_index=True)
        often = np.concatenate([n for _, n in words])[at]
        codes = [np.searchsorted(context, u) * len(word) + np.searchsorted(word, w) for u, w, _ in parts]
        pairs, place = _group(np.concatenate(codes))
        count = np.bincount(place, np.concatenate([n for _, _, n in parts]), len(pairs)).astype(np.int64)
        u, w = pairs // len(word), pairs % len(word)
        base = (often[w] + 1.0) / (total_tokens + vocabulary + 1.0)
        seen = np.maximum(np.bincount(u, count, len(context)) + alone, 1)
        scale = np.maximum(customers, seen) / seen
        keys = mix(context)[u] ^ word[w]
        tables = np.minimum(count, 1).astype(np.float64)
        kept = []
        for sweep in range(BURN_IN + SAMPLES):
            own = (np.bincount(u, tables, len(context)) + alone) * scale
            others = np.maximum(own[u] - tables, 0)
            tables = seat(count, (STRENGTH + DISCOUNT * others) * base, keys, sweep, DISCOUNT)
            if sweep >= BURN_IN:
                kept.append(tables.astype(np.uint32))
        chunk, answers = [], []
        start = 0
        for row, code in zip(order, codes):
            own = place[start : start + len(code)]
            start += len(code)
            chunk.append(blobs.column("chunk")[row].as_py())
            answers.append(_packed(np.concatenate([count[own], *(t[own] for t in kept)])))
        sums = [[np.bincount(ends, t, size).astype(np.int64) for t in kept] for ends, size in ((u, len(context)), (w, len(word)))]
        keys = np.concatenate([context, word]).view(np.int64)
        roles = np.repeat([0, 1], [len(context), len(word)]).astype(np.int32)
        n = len(keys)
        return pa.table({
            "bucket": pa.array([blobs.column("bucket")[0].as_py()] * len(chunk) + [None] * n, pa.int32()),
            "chunk": pa.array(chunk + [None] * n, pa.int64()),
            "answer": pa.array(answers + [None] * n, pa.binary()),
            "role": pa.concat_arrays([pa.nulls(len(chunk), pa.int32()), pa.array(roles)]),
            "key": pa.concat_arrays([pa.nulls(len(chunk), pa.int64()), pa.array(keys)]),
            **{
                f"t{s}": pa.concat_arrays([pa.nulls(len(chunk), pa.int64()), pa.array(np.concatenate([sums[0][s], sums[1][s]]))])
                for s in range(SAMPLES)
            },
        })

    return run


_ANSWERED = "bucket int, chunk bigint, answer binary, role int, key bigint, " + ", ".join(f"t{s} bigint" for s in range(SAMPLES))


def _parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of the parent for every word, from its customers, the tables of the children."""
    for batch in batches:
        words = batch.column("word").to_numpy().view(np.uint64)
        pull = batch.column("pull").to_numpy()
        arrays = [batch.column("word")]
        for s in range(SAMPLES):
            customers = batch.column(f"w{s}").to_numpy()
            tables = seat(customers, pull, words, BURN_IN + SAMPLES + s, DISCOUNT)
            arrays.append(pa.array(tables.astype(np.int64)))
        yield pa.RecordBatch.from_arrays(arrays, ["word", *(f"p{s}" for s in range(SAMPLES))])


def _score(buckets: int, hot: int, totals: dict):
    def run(key, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            empty = texts.select(["doc_id", "held_out"])
            return pa.table([empty.column(0), empty.column(1), *[pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names=_SCORED)
        words = told.filter(told.column("word").is_valid())
        kinds, total, order, u, w, n, sent, _, place, counts = _pairs(texts, words)
        column = lambda name: words.column(name).to_numpy()[order]
        deal = mix(kinds)[u]
        deal = np.where(total[u] >= hot, mix(deal ^ kinds[w]), deal) % np.uint64(buckets)
        some = np.flatnonzero(sent)
        some = some[np.argsort(deal[some], kind="stable")]
        count, tables = n.copy(), np.tile(np.where(sent, 0.0, n), (SAMPLES, 1))
        blobs = told.filter(told.column("answer").is_valid())
        sequence = np.argsort(blobs.column("bucket").to_numpy()).tolist()
        answers = [_unpacked(blobs.column("answer")[i].as_buffer()).astype(np.int64).reshape(1 + SAMPLES, -1) for i in sequence]
        if answers:
            joined = np.concatenate(answers, axis=1)
            count[some], tables[:, some] = joined[0], joined[1:]
        chance = np.zeros(len(n))
        for s in range(SAMPLES):
            parent = column(f"w{s}") - DISCOUNT * column(f"p{s}") + (STRENGTH + DISCOUNT * totals[f"p{s}"]) / (totals["vocabulary"] + 1)
            parent = np.maximum(parent, 1e-300) / (STRENGTH + totals[f"w{s}"])
            backed = (STRENGTH + DISCOUNT * column(f"u{s}"))[u] * parent[w]
            chance += (np.maximum(count - DISCOUNT * tables[s], 0) + backed) / (STRENGTH + total[u])
        size, vocabulary = totals["tokens"], totals["vocabulary"]
        base = np.log10((total + 1.0) / (size + vocabulary + 1.0))
        row = np.repeat(np.arange(len(counts)), counts)
        by_row = lambda values: np.bincount(row, values, len(counts))
        return pa.table([
            texts.column("doc_id"), texts.column("held_out"), pa.array(counts.astype(np.int64)), pa.array(by_row((total > 0)[w][place]).astype(np.int64)),
            pa.array(by_row(base[w][place])), pa.array(by_row(np.log10(chance / SAMPLES)[place])),
        ], names=_SCORED)

    return run


_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]


def score_documents(documents: DataFrame, held_out, cut, doc="doc_id", text="text", chunk_bytes: int = CHUNK_BYTES,
                    bucket_bytes: int = BUCKET_BYTES, hot_context: int = HOT_CONTEXT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    `held_out` is a column that is true for texts not learned from; `cut` writes a frame that
    is read again.
    """
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, buckets = max(1, -(-size // chunk_bytes)), max(1, -(-size // bucket_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    kind = documents.schema[doc].dataType.simpleString()
    words = cut(rows.groupBy("chunk").applyInArrow(_word_counts, "chunk bigint, word bigint, n bigint"))
    start = int(START.view(np.int64))
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("count"), F.count("*").alias("chunks")))
    size, vocabulary = counts.filter((F.col("word") != start) & (F.col("count") > 0)).agg(
        F.coalesce(F.sum("count"), F.lit(0)), F.count("*")
    ).first()
    known = cut(words.drop("n").join(counts, "word"))
    free(words, counts)
    asked = cut(rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_ask(buckets, hot_context), _ASKED))
    pairs = asked.drop("role", "key", "tables")
    answered = reduce(DataFrame.unionAll, [
        cut(pairs.filter(F.col("bucket") % _ROUNDS == turn).groupBy("bucket").applyInArrow(_seat_bucket(size, vocabulary), _ANSWERED))
        for turn in range(min(_ROUNDS, buckets))
    ])
    ts = [f"t{s}" for s in range(SAMPLES)]
    sums = answered.filter("key is not null").select("role", "key", *ts).unionAll(
        asked.filter("key is not null").select("role", "key", *[F.col("tables").alias(t) for t in ts])
    ).groupBy("key").agg(*[F.sum(F.when(F.col("role") == r, F.col(t))).alias(f"{'uw'[r]}{t[1:]}") for r in (0, 1) for t in ts])
    names = [f"{r}{s}" for r in "uw" for s in range(SAMPLES)]
    sums = cut(sums.select(F.col("key").alias("word"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names]))
    flat = (STRENGTH + DISCOUNT * vocabulary) / (vocabulary + 1.0)
    schema = "word bigint, " + ", ".join(f"p{s} bigint" for s in range(SAMPLES))
    free(asked)
    tables = cut(sums.withColumn("pull", F.lit(flat)).mapInArrow(_parent, schema))
    ps = [f"p{s}" for s in range(SAMPLES)]
    whole = sums.agg(*[F.coalesce(F.sum(f"w{s}"), F.lit(0)) for s in range(SAMPLES)]).first()
    seats = tables.agg(*[F.coalesce(F.sum(p), F.lit(0)) for p in ps]).first()
    totals = {"tokens": size, "vocabulary": vocabulary} | {f"w{s}": whole[s] for s in range(SAMPLES)} | {f"p{s}": seats[s] for s in range(SAMPLES)}
    facts = cut(known.join(sums.join(tables, "word"), "word", "left").select(
        "chunk", "word", "count", "chunks", *[F.coalesce(n, F.lit(0)).alias(n) for n in names + ps]
    ))
    free(known, sums, tables)
    told = facts.withColumn("bucket", F.lit(None).cast("int")).withColumn("answer", F.lit(None).cast("binary")).unionByName(
        answered.filter("answer is not null").select("chunk", "bucket", "answer"), allowMissingColumns=True
    )
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(buckets, hot_context, totals), schema)
    return scored.withColumn("train_tokens", F.lit(size).cast("long"))
