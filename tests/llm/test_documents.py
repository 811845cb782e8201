"""Operators on documents: nulls, empty and long texts, ties, repeated rows, empty tables."""

import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filescape import session
from filescape.llm import jaccard, language, mixing, packing, repeats, seating, wand
from filescape.llm import queries
from filescape.llm.suffix import suffix_array
from filescape.llm.words import mix, word_hashes
from tests.llm import brute


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture
def copies():
    """Texts with exact and near copies, shared passages, odd texts and one long one."""
    rng = random.Random(4)
    out, doc = {}, 0
    passage = sentence(rng, 60)
    for _ in range(12):
        own = sentence(rng, rng.randrange(20, 120)).split()
        for change in range(rng.randrange(1, 5)):
            text = list(own)
            for _ in range(change):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
            if rng.random() < 0.3:
                text[5:5] = passage.split()
            out[doc] = " ".join(text)
            doc += 1
    odd = [None, "", "   \n", "one", "ONE", "one two three", "One  two\tthree", "ä" * 200, "ä" * 200 + "ö", "ab" * 300, "ba" * 300, passage, passage.upper()]
    for text in [*odd, " ".join([sentence(rng, 3000), passage, sentence(rng, 3000)]), out[0], out[0]]:
        out[doc] = text
        doc += 1
    return out


def test_jaccard(spark, texts, cut, copies):
    rows = jaccard.link_documents(texts(copies), cut).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.jaccard(copies)


def test_jaccard_null_ids_and_repeats(spark, texts, cut):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A b c d e f"), (None, None), (7, None), (None, "z")]
    found = jaccard.link_documents(texts(rows), cut).collect()
    assert sorted(map(str, found)) == sorted(
        f"Row(doc_id={d}, n_shingles={n}, component_id={c})" for d, n, c in [(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (7, 0, 7), (None, 1, None)]
    )
    assert jaccard.link_documents(texts([]), cut).count() == 0


def test_jaccard_large_group(spark, texts, cut):
    rng = random.Random(9)
    base = sentence(rng, 200).split()
    rows = {}
    for doc in range(150):
        own = list(base)
        own[rng.randrange(200)] = f"y{doc}"
        rows[doc] = " ".join(own)
    rows |= {doc: sentence(rng, 80) for doc in range(200, 230)}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(texts(rows), cut).collect()}
    assert found == brute.jaccard(rows)


def test_jaccard_short_texts_in_shared_lists(spark, texts, cut):
    """Sets of 3 and 4 shingles link by 3 shared ones; unlinked texts have each of these too."""
    rng, rows = random.Random(12), {}
    for family in range(20):
        base = [f"f{family}w{i}" for i in range(7)]
        rows[len(rows)] = " ".join(base)
        rows[len(rows)] = " ".join([*base, "more"] if family % 2 else ["more", *base])
        for at in range(3):
            for _ in range(6):
                rows[len(rows)] = " ".join([*base[at : at + 5], sentence(rng, 6, 10**6)])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(texts(rows), cut).collect()}
    assert found == brute.jaccard(rows)


def by_doc(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot_strings", [repeats.HOT_STRINGS, 2])
def test_repeats(spark, texts, cut, copies, hot_strings):
    assert by_doc(repeats.without_repeats(texts(copies), cut, hot_strings=hot_strings)) == brute.repeats(copies)


def test_repeats_null_and_equal_ids(spark, texts, cut):
    long = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(4, long), (4, long), (None, long), (9, long[:40]), (5, None)]
    found = sorted((r.doc_id or -1, r.n_removed, r.kept_sha256) for r in repeats.without_repeats(texts(rows), cut).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == sorted([(4, 0, sha(long)), (4, 0, sha(long)), (-1, len(long), sha("")), (9, 0, sha(long[:40])), (5, 0, sha(""))])
    assert repeats.without_repeats(texts([]), cut).count() == 0


def test_seating_in_rounds_keeps_what_scores_need(spark, texts, cut):
    tables = []

    def counted(df):
        tables.append(cut(df))
        return tables[-1]

    rng = random.Random(11)
    rows = texts({i: sentence(rng, 30, 60) for i in range(40)})
    held_out = F.col("doc_id") % 4 == 0
    plain = {r.doc_id: r.score for r in seating.score_documents(rows, held_out, cut).collect()}
    scored = seating.score_documents(rows, held_out, counted, chunk_bytes=1000, bucket_bytes=600)
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx(plain)
    left = [t for t in tables if t in session._tables]
    assert sum("answer" in t.columns for t in left) == 4
    assert sum("word" in t.columns for t in left) == 1


def test_words_of_letters_are_encoded_together():
    encoder = packing.Encoder(queries.tokenizer())
    rng = random.Random(7)
    letters = "abZÀéßÿ×÷'’.,!&*<>|_-0٣…·ñ\u0338 \n"
    rows = pa.array(["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["don't&&", "É!!", "é…,", "×,", None, ""])
    ids, counts = encoder.encode(rows)
    plain_ids, plain_counts = encoder._plain(rows)
    assert ids.tolist() == plain_ids.tolist() and counts.tolist() == plain_counts.tolist()
    # words that differ in the marks behind a letter only are one
    encoder.forget()
    encoder.encode(pa.array(["wörter wörter&& wörter*** wörté wörté, wörté!!"]))
    assert len(encoder.keys) == 6
    words = ["straße", "élan", "plain", "unbelievably"]
    ids, counts = encoder._spaced(words)
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]


def test_repeats_leave_one_table_and_pass_on_what_counts(spark, texts, cut):
    tables = []

    def counted(df):
        tables.append(cut(df))
        return tables[-1]

    line = "a passage of well over fifty bytes that two of the documents hold. "
    rows = {1: line + "first one", 2: "another start " + line, 3: line + "first one"}
    spans = repeats.repeated_spans(texts(rows), counted)
    assert {r.doc for r in spans.collect()} == {2, 3}
    assert [t for t in tables if t in session._tables] == [spans]

    strings = spark.createDataFrame([(1, 11, 5, 9, b"x" * 60), (2, 12, 6, 6, b"y" * 60)], "key long, content long, low long, last long, string binary")
    assert {r.content for r in repeats.first_documents(strings, 50, 20).collect()} == {11}


def test_strings_are_not_dealt_to_find_those_of_hot_keys(spark, capsys):
    rows = [(7, at, at, at + 1, b"%02d" % at + b"x" * 60) for at in range(4)] + [(8, 9, 1, 2, b"y" * 60)]
    strings = spark.createDataFrame(rows, "key bigint, content bigint, low bigint, last bigint, string binary")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.first_documents(strings, 50, 20, hot_strings=2)
        found.explain()
        plan = capsys.readouterr().out
        assert {r.content for r in found.collect()} == {0, 1, 2, 3, 9}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_repeats_keep_whole_characters(spark, texts, cut):
    rows = {0: "ä" * 40 + "é", 1: "x" + "ä" * 40 + "é" + "ö"}
    kept = {r.doc_id: r.kept_text for r in repeats.without_repeats(texts(rows), cut, keep=("source", "score")).collect()}
    assert kept == {0: rows[0], 1: "xö"}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(400):
        symbols = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(symbols, int)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_mixing(spark, texts, cut):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(0, 90))) for i in range(120)] + [(500, None), (501, ""), (502, "\t"), (3, "a b"), (3, "a b"), (None, "q r s")]
    source = {i: ["b", "a", "é", None, "c"][i % 5] for i in range(600)}
    docs = texts(rows, sources=source)
    mixed, slots, goals = mixing.mix_sources(docs, cut, block_words=16)
    found, plan = mixed.collect(), slots.collect()
    assert len(found) == len(rows)
    total = sum(r["size"] for r in found)
    for goal in goals.collect():
        own = [r for r in found if r.source == goal.source]
        assert sum(r["size"] for r in own) == goal.source_size
        assert sum(r.taken for r in own) == goal.words == sum(s.words for s in plan if s.source == goal.source)
        assert goal.target <= 2 * goal.source_size and abs(goal.words - goal.target) <= 0.5
        ranks = sorted(s["rank"] for s in plan if s.source == goal.source)
        assert ranks == list(range(goal.slots))
    assert all(r.taken <= 2 * r["size"] for r in found)
    assert sum(g.target for g in goals.collect()) == pytest.approx(1.5 * total)
    again, _, _ = mixing.mix_sources(docs.repartition(3), cut, block_words=16)
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    # the first slots of the schedule are spread over the sources like all slots
    early = [s.source for s in plan if s.slot is not None and s.slot < len(plan) // 4]
    for goal in goals.collect():
        assert abs(early.count(goal.source) - goal.slots / 4) <= 4
    assert mixing.mix_sources(texts([]), cut)[0].count() == 0


def test_another_sequence_gives_other_slots(spark, texts, cut, monkeypatch):
    rows = {i: sentence(random.Random(i), 5 + i) for i in range(60)}
    docs = texts(rows, sources={i: "abc"[i % 3] for i in rows})

    def slots():
        mixed, plan, _ = mixing.mix_sources(docs, cut, block_words=16)
        plan = plan.collect()
        found = {r.doc_id: (r.start, r["size"], r.source, r.taken, r.first_slot) for r in mixed.collect()}
        for start, size, source, taken, slot in found.values():
            own = [s for s in plan if s.source == source and s.block * 16 < start + size and start < s.block * 16 + s.words]
            assert taken > 0 or not own
            assert slot == min((s.slot for s in own if s.slot is not None), default=None)
        return found

    first = slots()
    monkeypatch.setattr(mixing, "GOLDEN", 2**0.5 - 1)
    second = slots()
    assert {d: f[:4] for d, f in first.items()} == {d: f[:4] for d, f in second.items()} and first != second


def test_mixed_documents(spark, texts, cut):
    rows = {i: sentence(random.Random(i), 10 + i).replace(" ", "\n \t", 3) for i in range(40)}
    out = mixing.mixed_documents(texts(rows, sources={i: "ab"[i % 2] for i in rows}), cut).collect()
    assert sum(len(brute.words(r.text)) for r in out) == round(1.5 * sum(len(brute.words(t)) for t in rows.values()))
    assert all(rows[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in out)


def test_packing(spark, texts, cut):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer())
    rows = [(1, None), (2, ""), (3, "It's  a TEST, isn't it? 123.45!!\x0b<|endoftext|> x"), (4, "é.́ ,a."), (5, "don't!. 'S x.,;"), (5, "same"), (5, "same"), (None, "Ümlaut…")]
    rows += [(9, "long " * 3000 + "words. " * 3000)]
    want = {}
    for doc, text in rows:
        ids = (*own.encode(text or "", add_special_tokens=False).ids, 2)
        want[doc, len(ids)] = ids
    out = packing.pack(texts(rows), queries.tokenizer(), cut, length=64, partition_tokens=2000, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in out)
    pieces = {}
    for r in out:
        pieces.setdefault((r.doc_id, r.doc_tokens), {})[r.start] = r.ids
    # of the two equal rows either may be cut, so pieces of both may overlap
    got = {key: [None] * key[1] for key in pieces}
    for key, parts in pieces.items():
        for start, ids in parts.items():
            got[key][start : start + len(ids)] = ids
    assert {key: tuple(ids) for key, ids in got.items()} == want
    assert sum(r.length for r in out) == sum(map(len, want.values())) + 2
    sizes = {}
    for r in out:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert all(n <= 64 and n & (n - 1) == 0 for n in sizes.values())
    assert packing.pack(texts([]), queries.tokenizer(), cut).count() == 0


def test_hilbert_curve_steps():
    side, axes = 3, 3
    points = np.stack(np.meshgrid(*[np.arange(1 << side)] * axes, indexing="ij"), -1).reshape(-1, axes)
    keys = packing.hilbert_keys(points, side)
    assert sorted(keys) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_language(spark, texts):
    rng = random.Random(3)
    talk = {"xx": ["kalo", "mira", "tolu", "naki"], "yy": ["schreft", "strunz", "grolt", "pflum"]}
    rows, langs = [], {}
    for i in range(120):
        lang = ["xx", "yy"][i % 2]
        rows.append((i, " ".join(rng.choices(talk[lang], k=60))))
        langs[i] = lang
    docs = texts(rows, langs=langs)
    field = language.fit_field(docs, language.remainder("doc_id", 5) != 0)
    odd = [(1, None), (2, ""), (3, "123 --- !"), (4, "kalo mira " * 20 + "grolt pflum " * 12), (5, "STRUNZ grolt"), (5, "STRUNZ grolt"), (None, "mira"), (6, "mira " * 20_000)]
    found = language.identify(texts(odd), field, with_spans=True, keep=("component_id",)).collect()
    assert len(found) == len(odd)
    seen = {r.doc_id: r for r in found}
    assert [(seen[i].lang_pred, seen[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert (seen[4].lang_pred, seen[5].lang_pred, seen[None].lang_pred, seen[6].lang_pred) == ("xx", "yy", "xx", "xx")
    assert [(s.lang, s.words) for s in seen[4].spans] == [("xx", 40), ("yy", 24)]
    assert {r.component_id for r in found} == {7}
    assert language.identify(texts([]), field).count() == 0
    nothing = language.fit_field(texts({1: "a b"}), language.remainder("doc_id", 5) != 0)
    assert nothing is None and [r.lang_pred for r in language.identify(texts({1: "a b"}), nothing).collect()] == ["und"]


def test_pipeline_keeps_unlabelled_documents(spark, texts):
    docs = texts({1: "a b", 2: None, 3: "1 2 -", 4: "é"})
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()) == [1, 4]


def test_pipeline_near_duplicates_with_repeated_and_null_ids(spark, texts):
    near = ["a b c d e f g h i j", "a b c d e f g h i j k"]
    other, alone, empty = "q r s t u v w", "l m n o p", ""
    rows = [(5, near[0]), (5, near[1]), (3, near[0]), (5, other), (5, other), (None, near[1]), (None, alone), (7, empty), (8, empty)]
    kept = corpus_pipeline.drop_near_duplicates(spark, texts(rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, near[0]), (5, other), (None, alone), (7, empty), (8, empty)], key=str)


def predicted(field, rows):
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": rows, "letters": [True] * len(rows)})
    return language._identified(part, field, False).column("lang_pred").to_pylist()


def test_language_learns_short_texts_and_texts_without_blanks():
    rng = random.Random(6)
    talk = {"xx": ["kalo", "mira", "tolu", "naki"], "yy": ["schreft", "strunz", "grolt", "pflum"]}
    short = [(" ".join(rng.choices(talk[lang], k=3)), lang) for lang in ["xx", "yy"] * 40]
    assert predicted(language.fit(*zip(*short)), ["mira tolu naki", "pflum grolt strunz"]) == ["xx", "yy"]
    joined = {"aa": "的一是不了人我在有他", "zz": "のにはをたがでてとし"}
    mixed = [("".join(rng.choices(letters, k=200)), lang) for lang, letters in joined.items() for _ in range(40)]
    mixed += [(" ".join(rng.choices(talk["xx"], k=60)), "xx") for _ in range(40)] + short[1::2]
    rows = [*("".join(rng.choices(letters, k=80)) for letters in joined.values()), "mira tolu " * 9, "grolt pflum"]
    assert predicted(language.fit(*zip(*mixed)), rows) == ["aa", "zz", "xx", "yy"]
    assert predicted(language.fit(["one"], ["xx"]), ["one two"]) == ["xx"]
    assert language.fit(["", " "], ["xx", "yy"]) is None


def test_language_samples_every_label(spark, texts):
    docs = texts({i: f"word{i} other" for i in range(70)}, langs={i: f"l{i}" for i in range(70)})
    assert len(set(language.training_sample(docs, F.lit(True))[1])) == 70


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 1, 4])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, start = language.forward_backward(scores, counts, moves), 0
    for count in counts:
        own = scores[start : start + count]
        weight = np.zeros((count, 3))
        for path in np.ndindex(*[3] * count):
            p = np.exp(sum(own[t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                weight[t, k] += p
        if count:
            assert np.allclose(got[start : start + count], weight / weight.sum(axis=1, keepdims=True), atol=1e-5)
        start += count


def held(texts_frame):
    return language.remainder("doc_id", 7) == 2


def test_seating(spark, texts, cut, copies):
    rows = dict(copies)
    docs = texts(rows)
    found = {r.doc_id: r for r in seating.score_documents(docs, held(docs), cut, chunk_bytes=2000, bucket_bytes=3000, hot_context=20).collect()}
    for doc, (out, n, known, size, base) in brute.base_scores(rows).items():
        r = found[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, size) and r.base_score == pytest.approx(base)
        assert r.score < 0
    again = seating.score_documents(docs.repartition(3), held(docs), cut, chunk_bytes=2000, bucket_bytes=3000, hot_context=20)
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {d: round(r.score, 9) for d, r in found.items()}
    assert seating.score_documents(texts([]), held(docs), cut).count() == 0
    odd = seating.score_documents(texts([(None, None), (3, "a"), (3, "a")]), held(docs), cut).collect()
    assert len(odd) == 3


def plain_scores(texts, held):
    """The model with dictionaries, one pair after the other; chances are the operator's."""
    d, strength = seating.DISCOUNT, seating.STRENGTH

    @functools.cache
    def key(word):
        return int({None: seating.END, "": seating.START}[word] if not word else word_hashes(pa.array([word]))[0][0])

    tokens = {doc: ["", *brute.words(text), None] for doc, text in texts.items()}
    pairs, total = collections.Counter(), collections.Counter()
    for doc, own in tokens.items():
        if doc not in held:
            pairs.update(zip(own, own[1:]))
            total.update(own)
    size = sum(total.values()) - total[""]
    words = [w for w in total if w != ""]

    def seated(n, pull, code, sweep):
        return seating.seat(np.array([n]), np.array([pull]), np.array([code], np.uint64), sweep, d)[0]

    tables, samples = {pair: 1.0 for pair in pairs}, []
    for sweep in range(seating.BURN_IN + seating.SAMPLES):
        of = collections.Counter()
        for (u, w), t in tables.items():
            of[u] += t
        tables = {
            (u, w): seated(n, (strength + d * (of[u] - tables[u, w])) * (total[w] + 1) / (size + len(words) + 1),
                           int(mix(np.array([key(u)], np.uint64))[0]) ^ key(w), sweep)
            for (u, w), n in pairs.items()
        }
        samples.append(tables)
    flat = (strength + d * len(words)) / (len(words) + 1)
    averaged = []
    for s, tables in enumerate(samples[seating.BURN_IN :]):
        guests = {x: sum(t for (_, b), t in tables.items() if b == x) for x in words}
        averaged.append((tables, guests, {x: seated(int(n), flat, key(x), seating.BURN_IN + seating.SAMPLES + s) for x, n in guests.items()}))

    def chance(u, w):
        found = 0
        for tables, guests, upper in averaged:
            parent = (guests.get(w, 0) - d * upper.get(w, 0) + (strength + d * sum(upper.values())) / (len(words) + 1)) / (strength + sum(guests.values()))
            own = sum(t for (a, _), t in tables.items() if a == u)
            found += (max(pairs[u, w] - d * tables.get((u, w), 0), 0) + (strength + d * own) * parent) / (strength + total[u])
        return found / seating.SAMPLES

    known = {pair: chance(*pair) for own in tokens.values() for pair in zip(own, own[1:])}
    return {doc: sum(math.log10(known[pair]) for pair in zip(own, own[1:])) for doc, own in tokens.items()}, chance, words


def seated_texts():
    rng = np.random.default_rng(12)
    rows = {i: " ".join(f"w{min(int(k), 40)}" for k in rng.zipf(1.4, rng.integers(0, 40))) for i in range(60)}
    # a pair of six in one training text, and held-out copies that are dealt elsewhere
    rows[60] = "zeta omega " * 6
    rows |= {i: "zeta omega" for i in range(61, 70)} | {70: None, 71: "never seen words"}
    return rows, {i for i in rows if i % 5 == 0 and i < 60} | set(range(61, 72))


@pytest.mark.parametrize("chunk_bytes", [60, 900, 6 << 20])
def test_scores_of_plain_seating(spark, texts, cut, chunk_bytes):
    rows, held = seated_texts()
    docs = texts(rows)
    found = seating.score_documents(docs, docs.doc_id.isin(sorted(held)), cut, chunk_bytes=chunk_bytes, bucket_bytes=5 * chunk_bytes).collect()
    expected, _, _ = plain_scores(rows, held)
    assert {r.doc_id for r in found} == set(rows) and {r.doc_id for r in found if r.held_out} == held
    assert {r.doc_id: r.score for r in found} == pytest.approx(expected, abs=1e-9)


def test_predictions_sum_to_one(spark, texts, cut):
    """After each context, the probabilities of all words and of an unknown one add up to one."""
    rows = {i: "a b a c b a d" for i in range(12)}
    _, chance, words = plain_scores(rows, set())
    for context in ("", "a", "b", "c", "d", "zzz"):
        assert sum(chance(context, word) for word in [*words, "unknown"]) == pytest.approx(1)


def test_seats():
    """Tables follow the seating of one customer after the other, in runs as well."""
    customers, keys = np.array([1, 2, 5, 20, 200, 5000]), np.arange(6, dtype=np.uint64)
    tables = np.mean([seating.seat(customers, np.full(6, 1.0), keys, round_, 0.5) for round_ in range(400)], axis=0)
    rng = np.random.default_rng(1)

    def one(n):
        tables = 1
        for seated in range(1, n):
            tables += rng.random() < 1 / (1 + seated - 0.5 * tables)
        return tables

    expected = [np.mean([one(n) for _ in range(400 if n < 1000 else 60)]) for n in customers]
    assert tables[0] == 1 and tables == pytest.approx(np.array(expected), rel=0.08)


def test_search_keeps_the_best_of_all_shards_of_a_cell():
    """However many shards pass by in a task, k rows of a query leave it, the best in order."""
    words = [f"w{i}" for i in range(30)]
    rng = random.Random(5)
    docs = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(900)]
    hashes = np.sort(word_hashes(pa.array(words))[0])
    terms, weights = pa.array([hashes[:20].view(np.int64)]), pa.array([[0.1 * (i + 1) for i in range(20)]])
    asked = {"part": pa.array([3], pa.int32()), "role": pa.array([0], pa.int32()), "query_id": pa.array([7]), "body": pa.array([1]),
             "terms": terms, "weights": weights, "doc_id": pa.array([None], pa.int64()), "text": pa.array([None], pa.string())}
    passed = {"part": pa.array([3] * 900, pa.int32()), "role": pa.array([1] * 900, pa.int32()), "query_id": pa.nulls(900, pa.int64()), "body": pa.nulls(900, pa.int64()),
              "terms": pa.nulls(900, terms.type), "weights": pa.nulls(900, weights.type), "doc_id": pa.array(range(900)), "text": pa.array(docs)}
    batches = [pa.RecordBatch.from_pydict(rows) for rows in (asked, passed)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    found = [pa.Table.from_batches(list(wand._search(20.0, 5, 1.2, 0.75, size, kinds)(iter(batches)))) for size in (2_000, 1 << 20)]
    assert [t.num_rows for t in found] == [5, 5]
    assert found[0].equals(found[1])
    expected = []
    weight = dict(zip(hashes[:20].tolist(), weights[0].as_py()))
    for doc, text in enumerate(docs):
        counts = collections.Counter(word_hashes(pa.array([text]))[0].tolist())
        length = sum(counts.values())
        expected.append((-sum(weight.get(w, 0) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / 20)) for w, n in counts.items()), doc))
    assert found[0].column("doc_id").to_pylist() == [doc for _, doc in sorted(expected)[:5]]


def test_search(spark, texts, cut, copies):
    docs = texts(copies)
    queries = docs.filter("doc_id % 5 = 0")
    rows = wand.search(docs, queries, cut, k=4, shard_bytes=4000, query_bytes=3000).orderBy("query_id", "rank").collect()
    expected = brute.bm25(copies, [d for d in copies if d % 5 == 0], 4)
    for query, best in expected.items():
        own = [(r.doc_id, r.score) for r in rows if r.query_id == query]
        assert [d for d, _ in own] == [d for d, _ in best] and [s for _, s in own] == pytest.approx([s for _, s in best])
    assert wand.search(texts([]), texts([]), cut).count() == 0
    odd = texts([(None, "a b"), (1, "a"), (1, "a"), (2, None)])
    found = wand.search(odd, odd, cut).collect()
    assert [(r["rank"], r.doc_id) for r in found if r.query_id is None] == [(1, None), (2, 1), (3, 1)]
    assert [(r["rank"], r.doc_id) for r in found if r.query_id == 1] == [(1, 1), (2, 1), (3, None)]
