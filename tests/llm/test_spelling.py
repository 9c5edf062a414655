import random
import re
import zlib
from collections import Counter

import pytest
from cases import AWKWARD, docs

from netflow_spark.llm.spelling import deal_letters, near_pairs, spelling_variants, word_counts


def brute_words(rows, drop_every=97):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(n):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def sample(rng, n_docs, letters="abcdeé", stems=40):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(stems)]

    def typo(w):
        k, i = rng.randrange(6), rng.randrange(len(w))
        return [w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:], w[:i] + rng.choice(letters) + w[i:]][k] if k < 3 else w
    return [(i, " ".join(rng.choice(["%s", "%s,", "(%s)", "%s1"]) % typo(rng.choice(base)) for _ in range(60))) for i in range(n_docs)]


@pytest.mark.parametrize("drop_every,parts,heavy", [(97, 4, 2000), (2, 4, 2000), (5, 3, 2), (5, 4, 1)])
def test_as_brute_force(spark, drop_every, parts, heavy):
    rows = sample(random.Random(drop_every + heavy), 40)
    got = spelling_variants(docs(spark, rows), drop_every=drop_every, parts=parts, heavy=heavy)
    assert sorted(map(tuple, got.collect())) == brute(brute_words(rows, drop_every))


def test_all_pairs_are_found(spark):
    """Words of few letters and long repeats; every near pair once."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randrange(5, 8))) for _ in range(400)} | {"a" * 300, "a" * 301, "b" + "a" * 300, "zzzzz"})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1:] if is_near(a, b))
    for heavy in (2000, 5):
        got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in near_pairs(df, heavy=heavy).collect())
        assert got == want


def test_awkward_rows(spark):
    rows = AWKWARD + [(20 + i, "Straße ÀÉÎÕÜ àéîõü Hello hello HELLO×÷x hellо hel1lo") for i in range(4)] + [(None, "Nulls nulls NULLS")] + [(50, "twice twice twicee Twice")] * 3
    got = spelling_variants(docs(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(brute_words(rows))


def test_counts_without_drops(spark):
    got = {r.word: r.n for r in word_counts(docs(spark, [(1, "Lorem lorem LOREM ipsum")] * 2), drop_every=None, min_count=2).collect()}
    assert got == {"lorem": 6, "ipsum": 2}


def test_empty(spark):
    assert spelling_variants(docs(spark, [])).count() == 0
    assert spelling_variants(docs(spark, [(1, None), (2, "a b c")])).count() == 0


def test_letters_are_dealt_whole():
    dealt = deal_letters({"e": 10, "a": 5, "b": 5, "c": 1}, 3)
    assert sorted("".join(dealt)) == list("abce") and dealt[0] == "e"


def test_query_matches_sql(spark):
    import duckdb

    from netflow_spark.llm.queries import ORACLE, QUERIES
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(ORACLE["op13_spelling_variants"])
    names = [c[0] for c in want.description]
    got = QUERIES["op13_spelling_variants"](spark, sf)
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == names and rows == sorted(want.fetchall()) and len(rows) > 100
