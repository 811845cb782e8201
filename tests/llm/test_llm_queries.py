"""Every query of the subpackage on the smallest tables, next to its SQL or plain loops."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import check_oracle
import corpus_pipeline
from filescape.llm import queries
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall())


def collect(spark, name, *columns):
    return {row[0]: tuple(row[1:]) for row in queries.QUERIES[name](spark, SF_DIR).select(*columns).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name, monkeypatch):
    monkeypatch.setitem(check_oracle._KINDS, "double", "DOUBLE")
    problem, rows, _ = check_oracle.check(spark, check_oracle.connect(SF_DIR), SF_DIR, name)
    assert not problem and rows > 0


def test_language_held_out(spark):
    found = collect(spark, "op2_word_field", "doc_id", "held_out", "lang_pred", "score")
    gold = dict(duckdb.sql(f"select doc_id, lang from '{SF_DIR}/documents.parquet'").fetchall())
    assert set(found) == set(gold)
    assert all(held == (zlib.crc32(str(doc).encode()) % 5 == 0) for doc, (held, _, _) in found.items())
    held = [doc for doc in found if found[doc][0]]
    assert np.mean([found[doc][1] == gold[doc] for doc in held]) > 0.95
    assert all(0 <= score <= 1 for _, _, score in found.values())


def test_repeats(spark, texts):
    found = collect(spark, "op4_lyndon_groups", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == brute.repeats(texts)


def test_packing(spark, texts):
    own = Tokenizer.from_file(queries.tokenizer())
    expected = {doc: np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4") for doc, text in texts.items()}
    rows = queries.op5_curve_packing(spark, SF_DIR).collect()
    sequences, pieces = {}, {}
    for row in rows:
        ids = expected[row.doc_id][row.start : row.start + row.length]
        assert row.doc_tokens == len(expected[row.doc_id]) and row.ids_crc32 == zlib.crc32(ids.tobytes())
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
        pieces.setdefault(row.doc_id, []).append((row.start, row.length))
    for held in pieces.values():
        assert [start for start, _ in sorted(held)] == list(np.cumsum([0] + [n for _, n in sorted(held)])[:-1])
    assert {doc: sum(n for _, n in held) for doc, held in pieces.items()} == {doc: len(ids) for doc, ids in expected.items()}
    sizes = [sum(n for _, n in held) for held in sequences.values()]
    assert all(size <= 4096 and size & (size - 1) == 0 for size in sizes)
    for held in sequences.values():
        assert [at for at, _ in sorted(held)] == list(np.cumsum([0] + [n for _, n in sorted(held)])[:-1])


def test_vectors(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF_DIR}/embeddings.parquet'").fetchall()
    ids, labels = [row[0] for row in rows], np.array([row[2] for row in rows])
    points = np.array([row[1] for row in rows], float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    linked = (points @ points.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    group = brute.components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked))])
    found = collect(spark, "op7_pivot_lists", "vec_id", "n_links", "component_id", "kept")
    assert found == {i: (int(n), group[i], group[i] == i) for i, n in zip(ids, linked.sum(axis=1))}


def test_base_scores(spark, texts):
    found = collect(spark, "op8_word_seating", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    expected = brute.base_scores(texts)
    assert set(found) == set(expected)
    for doc, (*counts, base) in expected.items():
        assert list(found[doc][:4]) == counts and found[doc][4] == pytest.approx(base)
    held = [doc for doc in found if found[doc][0]]
    assert sum(found[doc][5] for doc in held) > sum(found[doc][4] for doc in held)


def test_search(spark, texts):
    rows = queries.op9_block_max(spark, SF_DIR).orderBy("query_id", "rank").collect()
    expected = brute.bm25(texts, [doc for doc in texts if doc % 100 == 0], 10)
    for query, best in expected.items():
        found = [(row.doc_id, row.score) for row in rows if row.query_id == query]
        assert [doc for doc, _ in found] == [doc for doc, _ in best]
        assert [score for _, score in found] == pytest.approx([score for _, score in best])
    assert {row.query_id for row in rows} == set(expected)


def test_jaccard(spark, texts):
    assert collect(spark, "op10_prefix_join", "doc_id", "n_shingles", "component_id") == brute.jaccard(texts)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = {doc: text for doc, text in texts.items() if any(c.isalpha() for c in text or "")}
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF_DIR)
        if place == 4:
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        rows = docs.collect()
        if place == 1:
            expected = {doc: expected[doc] for doc, (_, group) in brute.jaccard(expected).items() if doc == group}
        elif place == 2:
            removed = brute.repeats(expected)
            assert all(removed[r.doc_id][0] - len(r.text.encode()) <= removed[r.doc_id][1] for r in rows)
            assert all((removed[r.doc_id][1] == 0) == (r.text == expected[r.doc_id]) for r in rows)
            expected = {r.doc_id: r.text for r in rows}
        elif place == 3:
            # whole copies and at most one part, of at most twice the words
            taken = {}
            for r in rows:
                taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.words(r.text))
            assert all(n <= 2 * len(brute.words(expected[doc])) for doc, n in taken.items())
            total = sum(len(brute.words(text)) for text in expected.values())
            assert abs(sum(taken.values()) - 1.5 * total) < 40
        if place < 3:
            assert {r.doc_id: r.text for r in rows} == expected
        docs = spark.createDataFrame(rows, docs.schema)
    assert docs.count() > 0
