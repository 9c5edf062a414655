import hashlib
import random
import zlib

import pytest
from cases import AWKWARD, DOC_SCHEMA

from pyspark.sql import functions as F

from netflow_spark.llm.merkle import fold, merkle_manifest, outer_paths, tamper_check


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def climb(levels, at, node, fan):
    proof = []
    for nodes in levels[:-1]:
        first = at - at % fan
        run = nodes[first:first + fan]
        proof += [h for i, h in enumerate(run) if first + i != at]
        node = H(*[node if first + i == at else h for i, h in enumerate(run)])
        at //= fan
    return proof, node


def brute(rows, fan=8):
    """rows: (doc_id, text, lang, source, n_chars)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for v in trees.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    levels = {g: tree([leaf(r) for r in v], fan) for g, v in trees.items()}
    top = tree([levels[g][-1][0] for g in langs], fan)
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(trees[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            a, node = climb(levels[g], i, leaf(r, hit), fan)
            b, node = climb(top, k, node, fan)
            out.append((r[0], leaf(r), levels[g][-1][0], top[-1][0], H(*a, *b), node, node == top[-1][0]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, 99, "clash", "clash", "clash", "clash", 7) for i, t, g, s, n in rows], DOC_SCHEMA)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def manifest(df, fan, depth):
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return merkle_manifest(df, names, [F.col(c) for c in names[:-1]] + [low], hit, fan=fan, depth=depth)


def test_awkward_rows(spark):
    rows = [(i, t, g, s, n) for k, (i, t) in enumerate(AWKWARD) for g, s, n in [(["en", None, "", "=", "é", "zz"][k % 6], None if k == 3 else "S", k)]]
    rows += [(2**62 + i, "Large Id", "en", "x", None) for i in range(5)] + [(-4, "Neg", "en", "x", 1)]
    assert found(tamper_check(frame(spark, rows))) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("fan,depth", [(2, 1), (2, 2), (3, 1), (8, 1)])
def test_many_tiers(spark, fan, depth):
    rng = random.Random(fan * 10 + depth)
    rows = [(rng.randrange(200), rng.choice(["Aa", "b", None, "Ccc"]), rng.choice(["en"] * 5 + ["de", "fr", None, "x1", "x2", "x3", "x4", "x5"]), "s", 1) for _ in range(120)]
    assert found(manifest(frame(spark, rows), fan, depth)) == sorted(brute(rows, fan), key=repr)


def test_tamper_is_seen_and_nothing_else(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "s", 5) for i in range(60)]
    for r in tamper_check(frame(spark, rows)).collect():
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2))


def test_repeated_rows_and_single_leaf(spark):
    rows = [(1, "same", "en", "s", 4)] * 40 + [(2, "Alone", "de", "s", 5)]
    assert found(tamper_check(frame(spark, rows))) == sorted(brute(rows), key=repr)
    one = [(3, "x", None, None, None)]
    got = found(tamper_check(frame(spark, one)))
    assert got == brute(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")


def test_empty(spark):
    assert tamper_check(frame(spark, [])).count() == 0


def test_outer_paths_fold_to_the_top(spark):
    nodes = spark.createDataFrame([("t", i, H(str(i)), 30) for i in range(30)] + [("u", 0, H("u"), 1)], "tree string, pos long, hash string, size long")
    got = {(r.tree, r.pos): r for r in outer_paths(nodes, 3, 1).collect()}
    top = tree([H(str(i)) for i in range(30)], 3)[-1][0]
    assert all(fold(H(str(i)), got["t", i].path) == got["t", i].top == top for i in range(30))
    assert got["u", 0].top == H("u") and list(got["u", 0].path) == []


def test_query_matches_sql(spark):
    import duckdb

    from netflow_spark.llm.queries import ORACLE, QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(ORACLE["op12_merkle_manifest"])
    names = [c[0] for c in want.description]
    got = QUERIES["op12_merkle_manifest"](spark, sf)
    assert got.columns == names
    assert found(got) == sorted(want.fetchall(), key=repr)
