import functools
import random

import pytest
from cases import AWKWARD, docs, groups, shingles

from netflow_spark.llm import jaccard_join, regions
from netflow_spark.llm.jaccard_join import drop_near_copies, jaccard_components


def expected(rows, size, percent):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, size)

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and 100 * both >= percent * len(sets[a] | sets[b])

    return {i: (len(sets[i]), c) for i, c in groups(sorted(sets), linked).items()}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
    return out


@pytest.mark.parametrize("size,percent,pairs_a_member", [(4, 85, 64), (5, 80, 0), (1, 50, 0)])
def test_random_against_brute_force(spark, monkeypatch, size, percent, pairs_a_member):
    """Chains of edits around the threshold, shared passages, a large group of copies and near copies; with no
    pairs a member, regions take rounds of pivots as long as these get on."""
    monkeypatch.setattr(jaccard_join, "link_regions", functools.partial(regions.link_regions, pairs_a_member=pairs_a_member))
    rng = random.Random(size)
    vocabulary = [f"v{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 150))]
        for _ in range(6):
            texts.append(base)
            base = edited(rng, base, rng.randrange(0, 4))
        texts.append(passage + base[:40])
        texts.append(base + passage)
    hot = [rng.choice(vocabulary) for _ in range(80)]
    texts += [hot] * 40 + [edited(rng, hot, rng.randrange(1, 6)) for _ in range(60)]
    texts += [passage] * 3 + [passage[:-1]] + [["b", "a"], ["a", "b"], ["A", "b"], []]
    rng.shuffle(texts)
    rows = [(i * 3, " ".join(t)) for i, t in enumerate(texts)]
    want = expected(rows, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(spark, rows), size=size, percent=percent).collect()}
    assert got == want


def test_awkward_rows(spark):
    got = jaccard_components(docs(spark, AWKWARD), size=4, percent=85)
    assert got.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    rows = got.collect()
    assert len(rows) == len(AWKWARD)
    want = expected([r for r in AWKWARD if r[0] is not None], 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert all(r.component_id is None for r in rows if r.doc_id is None)


def test_dropping_keeps_one_of_each_group(spark):
    df = docs(spark, [r for r in AWKWARD if r[0] is not None])
    got = drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5, 6, 8, 10, 10, 11]


def test_empty(spark):
    assert jaccard_components(docs(spark, [])).count() == 0
    assert drop_near_copies(docs(spark, [(1, None), (2, "")])).count() == 2


def test_rows_without_a_partner_leave_their_region(spark):
    """By sizes and places, compared with all pairs: nobody with a possible partner of another component leaves."""
    rng = random.Random(3)
    rows = [(g, x, n, rng.randrange(0, n // 3 + 1), rng.randrange(4)) for g in range(30) for x in range(rng.randrange(1, 9)) for n in [rng.randrange(3, 60)]]
    df = spark.createDataFrame(rows, "g long, x long, n long, place long, c long")
    kept = {(r.g, r.x) for r in regions.with_partners(df, 80).collect()}

    def may_link(a, b):
        return (100 * min(a[2], b[2]) >= 80 * max(a[2], b[2])
                and 180 * min(a[2] - a[3], b[2] - b[3]) >= 80 * (a[2] + b[2]))

    needed = {a[:2] for a in rows for b in rows if a[0] == b[0] and a[4] != b[4] and may_link(a, b)}
    assert needed and needed <= kept and len(kept) < len(rows)
