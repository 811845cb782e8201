import math

import numpy as np
import pytest

from filescape.llm import pivots
from tests.llm import brute

SCHEMA = "vec_id bigint, embedding array<float>, label int, `class` string, links int, rank int"


def run(spark, cut, rows, **options):
    df = spark.createDataFrame([(i, e, label, "c", 1, 2) for i, e, label in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(df, cut, **options).collect()), key=str)


@pytest.mark.parametrize("block", [1024, 5])
def test_against_all_pairs(spark, cut, block):
    rng = np.random.default_rng(5)
    rows, number = [], 0
    for label in (0, 1):
        for _ in range(8):
            center = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((number, (center + rng.normal(size=16) * 0.1).astype(np.float32).tolist(), label))
                number += 1
    rows += [(number, rows[0][1], 0), (number + 1, rows[0][1], 1), (number + 2, [2 * x for x in rows[0][1]], 0)]
    points = np.array([e for _, e, _ in rows], float)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    labels = np.array([label for _, _, label in rows])
    linked = (points @ points.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    group = brute.components(range(len(rows)), zip(*np.nonzero(linked)))
    expected = sorted(((i, int(n), int(group[i]), bool(group[i] == i)) for i, n in enumerate(linked.sum(axis=1))), key=str)
    assert run(spark, cut, rows, block=block) == expected


def test_odd_vectors(spark, cut):
    e = [1.0, 2.0]
    rows = [(1, e, 1), (2, e, None), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [math.nan, 1.0], 1), (7, [math.inf, 1.0], 1),
            (8, [1.0, 2.0, 0.0], 1), (9, [], 1), (None, e, 1), (1, e, 1)]
    found = run(spark, cut, rows)
    alone = [(i, 0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9)]
    assert found == sorted([*alone, (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)], key=str)
    assert run(spark, cut, []) == []
