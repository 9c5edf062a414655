"""Small awkward tables and brute-force helpers of the training-data tests."""

import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, kept string, component_id string, _row string, x long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "   \n\t "), (6, "a b"), (7, "A B"), (8, LONG), (9, LONG + " tail"),
           (10, "é字😀 ▁ \x00 token=abcdefgh"), (10, "é字😀 ▁ \x00 token=abcdefgh"), (None, "a b c d e f"), (None, None), (11, "one\ntwo\none\n")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 99, "clash", "clash", "clash", "clash", 7) for i, t in rows], DOC_SCHEMA)


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingles(text, size):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def groups(nodes, linked):
    """Smallest member reachable, by brute force over all pairs."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
