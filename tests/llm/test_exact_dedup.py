import hashlib
from collections import defaultdict

from cases import AWKWARD, docs

from netflow_spark.llm.common import components
from netflow_spark.llm.exact_dedup import drop_exact_copies, exact_dedup


def expected(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    got = exact_dedup(docs(spark, AWKWARD))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(AWKWARD)


def test_saturated_filter_stays_exact(spark):
    rows = [(i, f"text {i % 300}") for i in range(700)]
    got = exact_dedup(docs(spark, rows), filter_bits=64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_normalized(spark):
    from pyspark.sql import functions as F
    got = exact_dedup(docs(spark, [(1, "A"), (2, "a")]), normalize=F.lower).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(1, 2), (2, 2)}


def test_whole_rows_kept(spark):
    df = docs(spark, [r for r in AWKWARD if r[0] is not None])
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 5, 6, 7, 8, 9, 10, 10, 11]


def test_one_row_each(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    data = AWKWARD + [(None, "only nulls"), (None, "only nulls"), (12, "only nulls?"), (20, "x"), (20, "y"), (20, "x")] + [(30, "often")] * 50
    want = [(2, "a b c d e f"), (4, ""), (10, AWKWARD[9][1]), (None, "only nulls"), (20, "x"), (20, "y"), (30, "often"), (12, "only nulls?")]
    want += [r for r in AWKWARD if r[0] in (5, 6, 7, 8, 9, 11)]
    for got in (drop_exact_copies(docs(spark, data), one_each=True), corpus_pipeline.exact_copies(spark, docs(spark, data), "")):
        assert sorted(((r.doc_id, r.text or "") for r in got.select("doc_id", F.col("text")).collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    assert drop_exact_copies(docs(spark, [])).count() == 0


def test_components(spark):
    import random
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(5000, x) for x in range(5001, 5100)] + [(7, 7), (8000, 8000)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
