"""Positive-unlabelled learning: its risk, its parts and whole queries."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filescape.llm import quality, queries

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int, score double, features string"


def test_risk_slopes_are_its_derivatives():
    rng = np.random.default_rng(2)
    for prior, shift in ((0.3, 2.0), (0.6, 0.0), (0.9, -3.0)):
        positive, unlabelled = rng.normal(size=7) + shift, rng.normal(size=9)
        good, bad = quality.risk(positive, unlabelled, prior)
        loss = lambda z: math.log1p(math.exp(-z))
        assert good == pytest.approx(prior * sum(map(loss, positive)) / 7)
        assert bad == pytest.approx(sum(loss(-z) for z in unlabelled) / 9 - prior * sum(loss(-z) for z in positive) / 7)
        # what is followed downwards: the whole risk, or only the second part turned round
        aim = (lambda p, u: sum(quality.risk(p, u, prior))) if bad >= 0 else (lambda p, u: -quality.risk(p, u, prior)[1])
        for sample, slope in zip((positive, unlabelled), quality.risk_slopes(positive, unlabelled, prior)):
            for i in range(len(sample)):
                sample[i] += 1e-5
                above = aim(positive, unlabelled)
                sample[i] -= 2e-5
                assert slope[i] == pytest.approx((above - aim(positive, unlabelled)) / 2e-5, abs=1e-6)
                sample[i] += 1e-5


def test_fit_and_prior_on_known_classes():
    """Two overlapping classes, of which only some members of one are known."""
    rng = np.random.default_rng(7)
    n, prior = 4000, 0.7
    truth = rng.random(n) < prior
    unlabelled = (rng.normal(size=(n, 5)) + np.where(truth, 1.2, -1.2)[:, None]).astype(np.float32)
    positive = (rng.normal(size=(1500, 5)) + 1.2).astype(np.float32)
    halves = quality._Contrast([quality.fit_contrast(positive[half::2], unlabelled[half::2]) for half in (0, 1)])
    found = quality.class_prior(*(np.bincount(halves(np.arange(len(rows)) % 2, rows), minlength=quality._PLACES) for rows in (positive, unlabelled)))
    assert abs(found - prior) < 0.04
    model = quality.fit(positive, unlabelled, prior)
    place = quality._Margin(model, unlabelled)
    counts = [np.bincount(place(None, rows), minlength=quality._PLACES) for rows in (positive, unlabelled)]
    scale, offset = quality.calibrate(place.margins(), *counts, prior)
    score = quality.sigmoid(scale * model.margins(model.bins(unlabelled)) + offset)
    assert np.mean((score >= 0.5) == truth) > 0.97
    assert score.mean() == pytest.approx(prior, abs=0.02)


def test_features_of_plain_counting():
    rows = ["", None, "Ab cd, cd cd! 12 é", "x\n" * 7, "ÄÖ $$$ ??? a.b a.b A.B", "q" * 3_000_000 + " Q" * 10]
    found = quality.text_features(pa.array(rows, pa.string()))
    assert found.shape == (len(rows), quality.FEATURES) and not found[:2].any()
    for row, text in zip(found[2:], rows[2:]):
        raw = text.encode()
        words = _WORD.findall(raw)
        folded = [w.lower() for w in words]
        counted = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        assert row[0] == pytest.approx(math.sqrt(counted[97:123].sum() / len(raw)))
        assert row[8 + quality._MARKS.index(ord("$"))] == pytest.approx(math.sqrt(raw.count(b"$") / len(raw)))
        assert (row[: quality._CLASSES] ** 2).sum() == pytest.approx(1, abs=1e-5)
        about = row[quality._CLASSES :]
        assert about[0] == pytest.approx(math.log1p(len(words)))
        assert about[1] == pytest.approx(np.mean([len(w) for w in words]), rel=1e-5)
        assert about[9] == pytest.approx(np.mean([0] + [a == b for a, b in zip(folded, folded[1:])]))
        assert about[10] == pytest.approx(len(set(folded)) / len(words))


def run(spark, cut, texts, rows, labels):
    documents = texts(rows)
    held = queries.language.remainder("doc_id", 5) == 0
    return quality.score_quality(documents, spark.createDataFrame([(*r, 0.5, "f") for r in labels], LABELS), held, cut).collect()


def test_odd_tables(spark, cut, texts):
    rows = [(1, "good text here"), (1, "good text here"), (None, "x"), (2, None), (3, ""), (4, "b " * 50_000)]
    for labels in ([], [(None, 1, 0), (9, 1, 0), (1, None, 1), (2, 0, 0)], [(1, 1, 0), (1, 0, 0)]):
        found = run(spark, cut, texts, rows, labels)
        assert len(found) == len(rows) and all(r.score == 0.5 and r.predicted == 1 for r in found)
    found = run(spark, cut, texts, rows, [(i, 1, 0) for i in (1, 2, 3, 4)])
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert run(spark, cut, texts, [], []) == []


def test_scores_need_texts_only(spark, cut, texts):
    """Marks of held-out texts, ids, languages and sources change no score."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    rows = {i: " ".join(word() + ("$$$" if i % 4 == 0 else "") for _ in range(30)) for i in range(400)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in rows}
    labels = [(i, int(i % 4 != 0), 0) for i in rows if i % 3 == 0]
    one = {r.doc_id: r for r in run(spark, cut, texts, rows, labels)}
    two = {r.doc_id: r for r in run(spark, cut, texts, rows, [(i, 1 - q if held[i] else q, 1) for i, q, _ in labels])}
    assert one == two and all(one[i].held_out == held[i] for i in rows)
    told = [i for i in rows if held[i]]
    assert np.mean([one[i].predicted == (i % 4 != 0) for i in told]) > 0.95


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_quality(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in queries.op13_trusted_positives(spark, sf_dir).collect()}
    gold = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    assert len(found) == duckdb.sql(f"select count(*) from '{sf_dir}/documents.parquet'").fetchall()[0][0]
    held = [i for i in gold if found[i].held_out]
    good, bad = [i for i in held if gold[i] == 1], [i for i in held if gold[i] == 0]
    assert np.mean([found[i].predicted == 1 for i in good]) > 0.98
    assert np.mean([found[i].predicted == 0 for i in bad]) > 0.95
