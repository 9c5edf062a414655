import random

import numpy as np
import pytest

from netflow_spark.llm.embeddings import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, rep long, copies long"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, "clash", 2, 3) for i, v, l in rows], SCHEMA)


def brute(rows):
    ok = [(i, np.array(v, dtype=np.float32).astype(float), l) for i, v, l in rows
          if i is not None and l is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, (i, v, l) in enumerate(ok):
        for j, w, m in ok[:a]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i and i is not None) for i in root}


@pytest.mark.parametrize("block,pivots", [(1024, 1024), (7, 40), (16, 3)])
def test_against_brute_force(spark, block, pivots):
    rng = np.random.default_rng(block)
    rows = []
    for k in range(25):
        c = rng.normal(size=16)
        for _ in range(12):
            rows.append((len(rows) * 2, (c + rng.normal(size=16) * rng.uniform(0.05, 0.5)).tolist(), k % 3))
    rows += [(10_000 + i, rows[5][1], rows[5][2]) for i in range(50)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 16, 1), (20_002, [float("nan")] * 16, 1), (20_003, [float("inf")] + [1.0] * 15, 1), (20_004, [], 1),
             (20_005, rows[0][1], None), (20_006, rows[0][1][:8], 0), (20_007, [None] + rows[0][1][1:], 0), (20_008, [-0.0, 1.0], 1), (20_009, [0.0, 2.0], 1)]
    random.Random(1).shuffle(rows)
    got = near_duplicates(table(spark, rows), block=block, max_pivots=pivots)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def test_null_ids_and_repeated_rows(spark):
    v = [1.0, 2.0]
    got = near_duplicates(table(spark, [(None, v, 1), (3, v, 1), (3, v, 1), (4, v, 1)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]


def test_empty(spark):
    assert near_duplicates(table(spark, [])).count() == 0
