"""Language of every word by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams with the word's ends, and whether
it is in the lexicon of frequent words; weights of hashed features and of the transitions
between languages are learned. Forward-backward over all words of a text gives each word's
language probabilities, so a text that switches languages is labelled piece by piece. The
language of a document is the one with most expected words, its score their share.

The field is fitted on a bounded sample: `sample` labelled documents of each language,
taken by a hash of the id, and of each `sample_chars` characters from a place set by the
hash. Training sequences join pieces of several documents, so that changes of language are
seen; a text too short for a whole piece is one. Every label is learned, unless `languages`
bounds their number, most frequent first. Prediction reads whole texts and nothing but texts.

A null text, and one without a letter, is `und` with score 0; so is every text when nothing
was labelled. Words without letters carry no weight. Rows with equal ids are rows of their
own, ties go to the first language in code point order, and an empty table gives no rows.
Labels and ids are looked at for training only, other columns not at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filescape.llm.tables import slices, tidied
from filescape.llm.words import mix, range_hashes, spans

UNKNOWN = "und"
SAMPLE, SAMPLE_CHARS = 300, 1500
BUCKETS = 1 << 15
LEXICON = 4096
_ROUNDS, _STEPS_WORDS, _PIECE = 6, 48, 12
#: Text bytes whose words advance together in forward-backward.
_TOGETHER = 2 << 20
#: Text bytes whose different words are described at once.
_DESCRIBED = 1 << 19
_GRAMS, _PREFIXES, _SUFFIXES = (2, 3), (2, 3, 4), (1, 2, 3, 4)


class Field:
    """Weights of a fitted field."""

    def __init__(self, languages: list[str], lexicon: np.ndarray):
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS, len(languages)), np.float32)
        self.moves = np.zeros((len(languages), len(languages)))

    def emissions(self, data, starts, ends) -> np.ndarray:
        """Scores of all languages for every word; nothing for words without letters."""
        keys = range_hashes(data, starts, ends)
        _, at, place = np.unique(keys, return_index=True, return_inverse=True)
        found, word = features(data, starts[at], ends[at], keys[at], self.lexicon)
        flat = self.weights[found]
        first = np.searchsorted(word, np.arange(len(at)))
        scores = np.add.reduceat(flat, first, axis=0) if len(at) else np.zeros((0, len(self.languages)), np.float32)
        scores[~lettered(data, starts[at], ends[at])] = 0
        return scores[place]


def lettered(data, starts, ends) -> np.ndarray:
    """Whether words have an ASCII letter or any byte beyond ASCII."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    sums = np.concatenate([[0], np.cumsum(letter)])
    return sums[ends] > sums[starts]


def features(data, starts, ends, keys, lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all features of the given words, in the order of words; every word
    has at least one."""
    size = ends - starts
    # the words with a mark at both ends, one after the other
    wide = size + 2
    at = np.cumsum(wide) - wide
    marked = np.zeros(wide.sum(), np.uint64)
    inside = np.ones(len(marked), bool)
    inside[at] = inside[at + wide - 1] = False
    source = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    raw = data[source].astype(np.uint64)
    marked[inside] = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    marked[at], marked[at + wide - 1] = 1, 2
    owner = np.repeat(np.arange(len(size)), wide)
    left = wide[owner] - (np.arange(len(marked)) - at[owner])  # symbols from here to the word's end
    buckets, words = [], []

    def add(places, length, kind, who):
        code = np.full(len(places), kind, np.uint64)
        for step in range(length):
            code = (code << np.uint64(9)) ^ marked[places + step]
        buckets.append(mix(code) % np.uint64(BUCKETS))
        words.append(who)

    for length in _GRAMS:
        places = np.flatnonzero(left >= length)
        add(places, length, length, owner[places])
    for length in _PREFIXES:
        who = np.flatnonzero(size >= length)
        add(at[who] + 1, length, 16 + length, who)
    for length in _SUFFIXES:
        who = np.flatnonzero(size >= length)
        add(at[who] + 1 + size[who] - length, length, 32 + length, who)
    if len(lexicon):
        place = np.minimum(np.searchsorted(lexicon, keys), len(lexicon) - 1)
        who = np.flatnonzero(lexicon[place] == keys)
        buckets.append(mix(keys[who] ^ np.uint64(64)) % np.uint64(BUCKETS))
        words.append(who)
    bucket, word = np.concatenate(buckets), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return bucket[order].astype(np.int64), word[order]


def forward_backward(scores: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probabilities of the languages of every word; `scores` holds the words of one text
    after those of another. All texts advance together, the longest first."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    step = np.repeat(np.arange(len(active)), active)
    line = np.arange(active.sum()) - np.repeat(np.cumsum(active) - active, active)
    place = first[line] + step
    emitted = scores[place].astype(np.float32)
    emitted = np.exp(emitted - emitted.max(axis=1, keepdims=True)) + np.float32(1e-12)
    change = np.exp(moves - moves.max()).astype(np.float32)
    ends = np.cumsum(active)
    ahead = np.empty_like(emitted)
    for t, stop in enumerate(ends):
        now = emitted[stop - active[t] : stop]
        if t:
            now = now * (ahead[ends[t - 1] - active[t - 1] : ends[t - 1] - active[t - 1] + active[t]] @ change)
        ahead[stop - active[t] : stop] = now / now.sum(axis=1, keepdims=True)
    back = np.ones((len(sizes), scores.shape[1]), np.float32)
    for t in range(len(active) - 1, 0, -1):
        count = active[t]
        low = ends[t] - count
        now = (back[:count] * emitted[low : low + count]) @ change.T
        ahead[low : low + count] *= back[:count]
        back[:count] = now / now.sum(axis=1, keepdims=True)
    if len(active):
        ahead[: active[0]] *= back[: active[0]]
    ahead /= ahead.sum(axis=1, keepdims=True)
    out = np.empty_like(ahead)
    out[place] = ahead
    return out


def fit(texts: list[str], labels: list[str], seed: int = 5) -> Field | None:
    """A field fitted to whole labelled texts, one language each; None where no text has a word."""
    data, starts, ends, counts = spans(pa.array(texts, pa.string()))
    languages = sorted({label for label, count in zip(labels, counts) if count})
    if not languages:
        return None
    keys = range_hashes(data, starts, ends)
    seen, often = np.unique(keys, return_counts=True)
    lexicon = np.sort(seen[np.argsort(-often, kind="stable")[:LEXICON]])
    field = Field(languages, lexicon)
    gold = np.repeat(np.searchsorted(languages, labels), counts)
    # pieces of the texts, the last of each may be shorter, joined at random to sequences
    pieces = [
        np.arange(low, min(low + _PIECE, start + count))
        for start, count in zip(np.cumsum(counts) - counts, counts)
        for low in range(start, start + count, _PIECE)
    ]
    rng = np.random.default_rng(seed)
    distinct, at, place = np.unique(keys, return_index=True, return_inverse=True)
    found, word = features(data, starts[at], ends[at], distinct, lexicon)
    bounds = np.searchsorted(word, np.arange(len(distinct) + 1))
    usable = lettered(data, starts[at], ends[at])
    past = np.full_like(field.weights, 1e-2)
    past_moves = np.full_like(field.moves, 1.0)
    n = len(languages)
    for _ in range(_ROUNDS):
        # runs of pieces of one text are kept together now and then, so both staying in a
        # language and changing it are seen
        blocks = [pieces[i : i + 2] for i in range(0, len(pieces), 2)]
        order = rng.permutation(len(blocks))
        line = [piece for block in order for piece in blocks[block]]
        per = _STEPS_WORDS // _PIECE
        sequences = [np.concatenate(line[i : i + per]) for i in range(0, len(line), per)]
        for low in range(0, len(sequences), 64):
            batch = sequences[low : low + 64]
            words = np.concatenate(batch)
            sizes = np.array([len(s) for s in batch])
            kinds, inverse = np.unique(place[words], return_inverse=True)
            run = bounds[kinds + 1] - bounds[kinds]
            own = np.repeat(bounds[kinds] - (np.cumsum(run) - run), run) + np.arange(run.sum())
            which = np.repeat(np.arange(len(kinds)), run)
            scores = np.zeros((len(kinds), n))
            for language in range(n):
                scores[:, language] = np.bincount(which, field.weights[found[own], language], len(kinds))
            scores[~usable[kinds]] = 0
            given = forward_backward(scores[inverse], sizes, field.moves)
            truth = np.eye(n)[gold[words]]
            error = truth - given
            error[~usable[kinds][inverse]] = 0
            by_kind = np.stack([np.bincount(inverse, error[:, language], len(kinds)) for language in range(n)], axis=1)
            for language in range(n):
                step = np.bincount(found[own], by_kind[which, language], BUCKETS) / 8
                past[:, language] += step * step
                field.weights[:, language] += 0.3 * step / np.sqrt(past[:, language])
            last = np.zeros(len(words), bool)
            last[np.cumsum(sizes) - 1] = True
            pair = np.flatnonzero(~last)
            seen_moves = truth[pair].T @ truth[pair + 1]
            change = np.exp(field.moves - field.moves.max())
            emitted = np.exp(scores[inverse] - scores[inverse].max(axis=1, keepdims=True))
            joint = _joint(emitted, sizes, change)
            step = (seen_moves - joint) / max(len(pair), 1)
            past_moves += step * step
            field.moves += 0.5 * step / np.sqrt(past_moves)
    return field


def _joint(emitted: np.ndarray, sizes: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Expected number of moves between languages over sequences of equal or unequal length."""
    total = np.zeros_like(change)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        place = (np.cumsum(sizes) - sizes)[rows][:, None] + np.arange(size)
        e = emitted[place] + 1e-12
        ahead = np.empty_like(e)
        ahead[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, size):
            now = e[:, t] * (ahead[:, t - 1] @ change)
            ahead[:, t] = now / now.sum(axis=1, keepdims=True)
        back = np.ones_like(e[:, 0])
        for t in range(size - 1, 0, -1):
            after = back * e[:, t]
            pair = ahead[:, t - 1][:, :, None] * change[None] * after[:, None, :]
            total += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back = after @ change.T
            back /= back.sum(axis=1, keepdims=True)
    return total


def training_sample(documents: DataFrame, usable: Column, doc="doc_id", text="text", lang="lang", sample: int = SAMPLE,
                    chars: int = SAMPLE_CHARS, languages: int | None = None) -> tuple[list[str], list[str]]:
    """(texts, labels): a bounded number of labelled rows of every language."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), usable.alias("usable"))
    rows = rows.filter(F.col("usable") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = {row[0]: row[1] for row in (labels if languages is None else labels.limit(languages)).collect()}
    if not counts:
        return [], []
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for name, count in counts.items() for x in (name, min(1.0, 2.0 * sample / count))])
    drawn = rows.withColumn("at", place).filter(F.col("at") < share[F.col("lang")])
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    piece = F.substring("text", start, F.lit(chars))
    picked = drawn.select("lang", piece.alias("piece"), "at").orderBy("at", "lang", "piece").limit(2 * sample * len(counts)).collect()
    kept: dict[str, int] = {}
    texts, labels = [], []
    for row in picked:
        kept[row["lang"]] = kept.get(row["lang"], 0) + 1
        if kept[row["lang"]] <= sample:
            texts.append(row["piece"])
            labels.append(row["lang"])
    return texts, labels


def identify(documents: DataFrame, field: Field | None, doc="doc_id", text="text", with_spans: bool = False,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) per row; with `with_spans` the runs of words of one
    language as an array of (lang, first word, number of words), and the columns `keep`."""
    kind = documents.schema[doc].dataType.simpleString()
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    others = [name for name in keep if name != text]
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), has_letter.alias("letters"), *[F.col(name).alias(f"_{name}") for name in others])
    schema = f"doc_id {kind}, lang_pred string, score double"
    if with_spans:
        schema += ", spans array<struct<lang:string,first:bigint,words:bigint>>"
    schema += "".join(f", `{name}` {documents.schema[name].dataType.simpleString()}" for name in keep)
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text", _TOGETHER):
                found = _identified(part, known, with_spans)
                passed = [part.column("text" if name == text else f"_{name}") for name in keep]
                yield pa.RecordBatch.from_arrays([*found.columns, *passed], [*found.schema.names, *keep])

    return rows.mapInArrow(tidied(run), schema)


def _identified(part: pa.RecordBatch, field: Field | None, with_spans: bool) -> pa.RecordBatch:
    letters = part.column("letters").to_numpy(zero_copy_only=False)
    names, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
    found = [[] for _ in range(part.num_rows)]
    if field is not None and field.languages and part.num_rows:
        scores, counts, useful = [], [], []
        for small in slices(part, "text", _DESCRIBED):
            data, starts, ends, count = spans(small.column("text"))
            scores.append(field.emissions(data, starts, ends))
            counts.append(count)
            useful.append(lettered(data, starts, ends))
        counts = np.concatenate(counts)
        given = forward_backward(np.concatenate(scores), counts, field.moves)
        useful = np.concatenate(useful)
        row = np.repeat(np.arange(len(counts)), counts)
        expected = np.stack([np.bincount(row[useful], given[useful, i], len(counts)) for i in range(given.shape[1])], axis=1)
        total = expected.sum(axis=1)
        known = letters & (total > 0)
        best = expected.argmax(axis=1)
        names[known] = np.array(field.languages, object)[best[known]]
        score[known] = np.minimum(expected[known, best[known]] / total[known], 1.0)
        if with_spans:
            word = given.argmax(axis=1)
            fresh = np.ones(len(word), bool)
            fresh[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(fresh)
            begin = (np.cumsum(counts) - counts)[row[at]]
            for i, size, low in zip(at, np.diff(np.append(at, len(word))), at - begin):
                if known[row[i]]:
                    found[row[i]].append({"lang": field.languages[word[i]], "first": int(low), "words": int(size)})
    arrays = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)]
    if with_spans:
        arrays.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))))
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans)


def remainder(doc: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % by


def fit_field(documents: DataFrame, usable: Column, doc="doc_id", text="text", lang="lang", **bounds) -> Field | None:
    texts, labels = training_sample(documents, usable, doc, text, lang, **bounds)
    return fit(texts, labels) if texts else None
