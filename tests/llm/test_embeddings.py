"""Lattice hashing against all pairs."""

from __future__ import annotations

import numpy as np

from samebytes.llm import embeddings as em
from tests_llm_helpers import brute_components


def test_lattice_points_are_nearest():
    x = np.random.default_rng(1).normal(0, 2, (300, 8))
    near = em.decode(x)
    gap = ((x - near) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all()
    for step in em.neighbours():
        assert (((x - near - step) ** 2).sum(axis=1) >= gap - 1e-9).all()


def test_links_and_components_equal_all_pairs(spark):
    some = np.random.default_rng(6)
    rows, number = [], 0
    for group in range(30):
        base = some.normal(size=64)
        for _ in range(1 + group % 9):
            rows.append((number, (base + some.normal(size=64) * some.choice([0, 0.05, 0.14, 0.2])).astype(np.float32), group % 3))
            number += 1
    rows += [(number + i, rows[40][1], rows[40][2]) for i in range(12)]
    table = [(i, [float(x) for x in v], label) for i, v, label in rows]
    unit = np.array([v / np.linalg.norm(v) for v in (r[1].astype(float) for r in rows)])
    labels = np.array([r[2] for r in rows])
    close = (unit @ unit.T >= em.MIN_COSINE) & (labels[:, None] == labels)
    np.fill_diagonal(close, False)
    components = brute_components(np.argwhere(close).tolist(), range(len(rows)))
    awkward = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] + [1.0] * 63, 1), (1003, [], 1),
               (1004, table[0][1], None), (None, table[0][1], 0), (1005, [1.0, None], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    df = spark.createDataFrame(table + awkward, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in em.near_vectors(df).collect()}
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(rows))} == {
        i: (int(close[i].sum()), components[i]) for i in range(len(rows))
    }
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, None, 1005))
    assert (got[1006].n_links, got[1007].component_id) == (1, 1006)
    assert em.near_vectors(df.limit(0)).count() == 0
