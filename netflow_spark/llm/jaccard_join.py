"""N-gram Jaccard join: Voronoi regions of pivots, triangle-inequality windows, recursive exact joins.

A document's set holds its distinct word n-grams (64-bit hashes); with fewer words the whole sequence
is its only member, without words the set is empty and linked with nothing. Two documents link when
``100 * intersection >= percent * union``, that is, at Jaccard distance ``r = 1 - percent / 100`` or less.

Almost all documents are at distance 1 of any document chosen as a pivot, so document pivots alone
would replicate everything everywhere. The first pivots are therefore the singleton sets ``{g}``, in
one global order (rare n-grams first, so that common passages separate nothing):

* Regions: a document's nearest pivot is its first n-gram.
* Windows: if the first ``k`` n-grams of x are missing in y, then ``d(x, y) >= k / |x|``. So x is
  replicated to the regions of its first ``floor(r |x|) + 1`` n-grams, and linked documents meet in
  the region of the first n-gram they share there.
* Recursion: inside a region the document with the fewest n-grams before the region's is the next
  pivot. All others are compared with it; what lies within ``r`` is linked to it, and as only
  reachability is asked for, documents already in one component are never compared again. The
  pivot then leaves, and so do documents that sizes and places in the order keep from a link to any
  other component. A region whose documents are all in one component is finished, however large.
  A crowded one recurs around its next pivot; one with few pairs between components a document is
  compared pair by pair, if distances to the pivot (triangle inequality) allow a link at all.
* All comparisons are screened first by the documents' distances to fixed parts of the set of all
  n-grams, which by the triangle inequality can't differ by more than the documents themselves.

Identical sets are one class from the start, so copies are neither shuffled nor compared.
Null text is empty text. Rows with a null id have a null component and link nothing; rows that
repeat an id are one document. Empty tables give empty results. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bloom_words, id_and_text, is_empty, mark_members, written
from .regions import link_regions, most_size, sizes_allow
from .words import mix, released, text_chunks, words_of

_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HEAVY_PER_TASK, HEAVY_TOTAL = 1 << 17, 1 << 19
SKETCH = 128


def shingle_sets(texts: pa.Array, size: int):
    """For each text of a slice of ``text_chunks`` its sorted distinct n-gram hashes (uint64)."""
    *_, doc, h = words_of(texts, lower=True)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(h) - size + 1
    grams = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(size):
        if n > 0:
            grams += h[j:j + n] * _FACTORS[j]
    grams = mix(grams)
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            yield np.unique(grams[a:b - size + 1])
        elif b > a:
            yield mix((h[a:b] * _FACTORS[:b - a]).sum(dtype=np.uint64, keepdims=True) + _FACTORS[size + b - a])
        else:
            yield grams[:0]


def window_size(n: int, percent: int) -> int:
    """How many of its first n-grams a set of ``n`` must share one of with any set it links to."""
    return n - -(-percent * n // 100) + 1


def _count_frequent(size: int):
    """Misra-Gries summary of one task: n-grams with the number of documents that hold them, as a lower bound."""
    def merge(keys, counts, more):
        new, times = np.unique(np.concatenate(more), return_counts=True)
        allk, inv = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total = np.zeros(len(allk), dtype=np.int64)
        np.add.at(total, inv, np.concatenate([counts, times]))
        if len(allk) > HEAVY_PER_TASK:
            total -= np.partition(total, -HEAVY_PER_TASK - 1)[-HEAVY_PER_TASK - 1]
        return allk[total > 0], total[total > 0]

    def run(batches):
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        more: list = []
        waiting = 0
        for batch in batches:
            for _, texts in text_chunks(batch.column(0)):
                for s in shingle_sets(texts, size):
                    more.append(s)
                    waiting += len(s)
                if waiting > 1 << 20:
                    keys, counts = merge(keys, counts, more)
                    more, waiting = [], 0
        if waiting:
            keys, counts = merge(keys, counts, more)
        keep = counts >= 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], names=["g", "n"])
    return released(run)


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``HEAVY_TOTAL`` most frequent n-grams (sorted) and their counts, gathered over all documents.

    They only set the order of the pivots; any order gives the same links.
    """
    parts = docs.select("_text").mapInArrow(_count_frequent(size), "g long, n long")
    counts = written(parts.groupBy("g").agg(F.sum("n").alias("n")), "frequent")
    least, room = 1 << 62, HEAVY_TOTAL
    for n, times in sorted(((r["m"], r["k"]) for r in counts.groupBy(F.least("n", F.lit(1 << 16)).alias("m")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True):
        if times > room:
            break
        least, room = n, room - times
    top = counts.where(F.col("n") >= least).toPandas()
    g, n = top["g"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64)
    order = np.argsort(g)
    return g[order], n[order]


def _windows(size: int, percent: int, heavy: np.ndarray, times: np.ndarray):
    def run(batches):
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                n, prints, windows, sketches = [], [], [], []
                for s in shingle_sets(texts, size):
                    n.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketches.append(np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes())
                    if len(s) and len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        rank = np.where(heavy[at] == s, times[at], 0)
                        s = s[np.lexsort((s, rank))] if rank.any() else s
                    windows.append(s[:window_size(len(s), percent)] if len(s) else s)
                off = np.concatenate([[0], np.cumsum([len(w) for w in windows])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(windows).view(np.int64)))],
                    names=["_id", "n", "print", "sketch", "grams"])
    return released(run)


def _screen(percent: int):
    """Leaves out pairs whose sketches differ by more than linked sets can: the sketch counts the set's
    members in ``SKETCH`` parts of all n-grams, and the counts differ by no more than the sets do."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int64) for i in (2, 3))
            sizes = b.column(4).to_numpy() + b.column(5).to_numpy()
            # |x and y| >= p (|x| + |y|) / (100 + p), so the sets differ in (100 - p) (|x| + |y|) / (100 + p) members at most
            near = np.abs(x - y).sum(axis=1) * (100 + percent) <= (100 - percent) * sizes
            yield b.select([0, 1]).filter(pa.array(near))
    return released(run)


def _compare(size: int, percent: int):
    """Exact distances of rows (a, b, text of a, text of b), sorted by b."""
    def one(column, i):
        return next(shingle_sets(next(text_chunks(column.slice(i, 1)))[1], size))

    def run(batches):
        last, kept = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            d, linked = [], []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, kept = b[i], one(batch.column(3), i)
                mine = one(batch.column(2), i)
                both = len(np.intersect1d(mine, kept, assume_unique=True))
                union = len(mine) + len(kept) - both
                d.append(1 - both / union)
                linked.append(100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "d", "linked"])
    return released(run)


def _comparer(texts: DataFrame, rows: DataFrame, size: int, percent: int, filter_bits: int):
    """Exact distances of the pairs (a, b) whose sketches allow a link: ``(a, b, d, linked)``.

    Only texts of documents in such pairs move; they are smaller than the sets made of them.
    """
    def compare(pairs: DataFrame) -> DataFrame:
        ka, kb = (rows.select(F.col("_id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
        screened = written(pairs.join(ka, "a").join(kb, "b").select("a", "b", "sa", "sb", "na", "nb")
                           .mapInArrow(_screen(percent), "a long, b long").distinct(), "screened")
        if is_empty(screened):
            return screened.select("a", "b", F.lit(1.0).alias("d"), F.lit(False).alias("linked"))
        ids = written(screened.select(F.explode(F.array("a", "b")).alias("_id")).distinct(), "members")
        some = written(bloom_words(ids, "_id", filter_bits), "bloom")
        met = mark_members(texts, F.col("_id"), some, "_met", filter_bits).where("_met").select("_id", "_text")
        whole = written(met.join(ids, "_id", "left_semi"), "texts")
        ta, tb = (whole.select(F.col("_id").alias(c), F.col("_text").alias(f"t{c}")) for c in "ab")
        both = screened.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(_compare(size, percent), "a long, b long, d double, linked boolean")
    return compare


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80,
                       filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``class_id`` (smallest id with the same set) and
    ``component_id`` (smallest id reachable by links)."""
    texts = id_and_text(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_text")
    heavy, times = frequent_shingles(texts, size)
    rows = written(texts.mapInArrow(_windows(size, percent, heavy, times), "_id long, n long, print binary, sketch binary, grams array<long>"), "windows")
    linkable = rows.where("n > 0 and _id is not null")

    # classes of identical sets; only sets that may be repeated are shuffled
    words = written(bloom_words(linkable, "print", filter_bits, repeated=True), "bloom")
    marked = mark_members(linkable, F.col("print"), words, "_maybe", filter_bits)
    classes = written(marked.where("_maybe").groupBy("print").agg(F.min("_id").alias("cls")), "classes")
    first = (marked.where("_maybe").select("_id", "n", "print", "grams").alias("l")
             .join(classes.alias("r"), F.expr("l._id = r.cls and l.print = r.print"), "left_semi").dropDuplicates(["_id", "print"]))
    reps = marked.where(~F.col("_maybe")).select("_id", "n", "grams").unionByName(first.select("_id", "n", "grams"))

    # regions: place in the order and size travel as one number
    tokens = reps.select(F.col("_id").alias("x"), "n", F.posexplode("grams").alias("place", "g")).select(
        "g", "x", (F.shiftleft(F.col("n"), 24) + F.col("place")).alias("np"))
    size_of, place_of = F.shiftright("np", 24), F.col("np").bitwiseAND((1 << 24) - 1)
    most = most_size(size_of, place_of, percent)
    held = tokens.groupBy("g").agg(F.count(F.lit(1)).alias("_k"), F.min("x").alias("_first"), F.max("x").alias("_last"),
                                   F.min(F.struct(place_of.alias("place"), F.col("x"), size_of.alias("n"))).alias("p"),
                                   F.min(size_of).alias("_n1"), F.max(size_of).alias("_n2"), F.min(size_of - place_of).alias("_most"), F.max(most).alias("hi"))
    # a region of two documents whose sizes or places rule out a link (the first n-gram they share is tried in its own region)
    apart = (F.col("_k") == 2) & (~sizes_allow("_n1", "_n2", percent) | ((100 + percent) * F.col("_most") < percent * (F.col("_n1") + F.col("_n2"))))
    # written, so that both sides of the join are shuffled anew and a common n-gram's region can be split
    shared = written(held.where("_first <> _last").where(~apart).select("g", F.col("p.x").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.place").alias("pplace"), F.col("_n1").alias("lo"), "hi"), "shared")
    common = written(bloom_words(shared, "g", filter_bits), "bloom")
    met = mark_members(tokens, F.col("g"), common, "_met", filter_bits).where("_met").drop("_met")
    # a document whose region holds none small enough for its place, or none whose place allows its size, has no link there
    met = met.join(shared, "g").where((F.col("lo") <= most) & (F.col("hi") >= size_of))
    regions = written(met.select("g", "x", size_of.alias("n"), place_of.alias("place"), "pivot", "pn", "pplace"), "regions")
    compare = _comparer(texts, rows.where("n > 0 and _id is not null"), size, percent, filter_bits)
    comp = written(link_regions(regions, compare, percent), "components")

    # back to all documents: by set, so that copies get their class's component
    by_class = classes.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left")
    by_class = written(by_class.select("print", "cls", F.coalesce("component", "cls").alias("component")), "by_class")
    alone = written(comp.select(F.col("node").alias("_id"), "component"), "by_id")
    maybe = mark_members(rows, F.col("print"), words, "_maybe", filter_bits).withColumn("_maybe", F.col("_maybe") & F.expr("n > 0 and _id is not null"))
    copies = maybe.where("_maybe").join(by_class, "print", "left").select("_id", "n", "cls", "component")
    others = maybe.where(~F.col("_maybe") | F.col("_maybe").isNull()).join(alone, "_id", "left").select(
        "_id", "n", F.col("_id").alias("cls"), F.coalesce("component", "_id").alias("component"))
    return copies.unionByName(others).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
                                             F.col("cls").alias("class_id"), F.col("component").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, of the smallest id of every component.

    Rows are left out by the Bloom filter of the ids that go; only rows it may hold are shuffled.
    """
    cols = docs.columns
    found = jaccard_components(docs, id_col, text_col, size, percent)
    gone = written(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("_id")).distinct(), "gone")
    words = written(bloom_words(gone, "_id"), "bloom")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    marked = mark_members(whole, F.col("_id"), words, "_gone")
    out = marked.where(~F.col("_gone")).select("_row").unionByName(
        marked.where("_gone").join(gone, "_id", "left_anti").select("_row"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols])
