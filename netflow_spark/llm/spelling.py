"""Spelling variants by PartEnum signatures.

Two words are near if one insertion, deletion or replacement of a code point turns one into the other. Their
letter multisets, as binary vectors over (letter, occurrence), then differ in at most two places (Hamming).
PartEnum makes that an equi-join: the letters are dealt into ``parts`` parts of about equal weight, at most two
parts of two near words differ, so of all ways to leave two parts out one gives the same projection for both.
Every word emits one signature for each way; words that share a signature are candidates, verified by edit
distance. Letters are counted over all words; how they are dealt changes cost only.

Multisets say nothing about order, and many words are made of the same letters, so a signature also carries a
length and one half of the word as it is written. For a pair whose shorter word has ``m`` code points, either
the first ``m div 2`` or the last ``m - m div 2`` code points are the same, whichever the edit is not in. Each
word emits this for its own length and as the longer word of a pair.

Words that share a signature with more than ``heavy`` others are signed again with twice as many parts, inside that
signature, until no signature is heavy or every part is one letter; what is still heavy then shares all but two
letters and half the word, and is joined as it is (adaptive execution splits it). Nothing is left out.

Words: maximal runs of A-Z, a-z and U+00C0 to U+00FF of the whole text, A-Z lower-cased. Null text has none; a null
id reads as an empty one. Repeated rows count each time. An empty table gives an empty result.
Only the id and the text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, is_empty, written

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, DROP_EVERY = 5, 3, 97
PARTS, HEAVY = 4, 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = DROP_EVERY,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)`` of all words that are long and frequent enough. Where ``drop_every`` divides the CRC-32 of
    ``<id>:<word>``, the word's occurrences in that document lose the code point at that number modulo their length."""
    text = F.translate(F.col("_text"), _UPPER, _LOWER)
    run = id_and_text(docs, id_col, text_col).select("_id", F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))).alias("word"))
    run = run.where(F.length("word") >= min_length)
    if drop_every:
        run = run.withColumn("_h", F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary")))
        at = (F.col("_h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        run = run.select(F.when(F.col("_h") % drop_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return run.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def deal_letters(weight: dict[str, int], parts: int) -> list[str]:
    """Letters of each part; parts of about equal weight (heaviest letters first, each to the lightest part)."""
    out, load = [""] * parts, [0] * parts
    for letter in sorted(weight, key=lambda c: (-weight[c], c)):
        i = load.index(min(load))
        out[i] += letter
        load[i] += weight[letter]
    return out


def _signatures(weight: dict[str, int], parts: int, *more) -> F.Column:
    """One hash for each way to leave two parts of the letters out; ``more`` goes into every hash."""
    dealt = deal_letters(weight, parts)
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    of = [F.translate(letters, "".join(dealt[:i] + dealt[i + 1:]), "") for i in range(parts)]
    return F.array(*[F.xxhash64(F.lit(k), *[of[i] for i in kept], *more) for k, kept in enumerate(combinations(range(parts), parts - 2))])


def _signed(words: DataFrame, weight: dict[str, int], parts: int) -> DataFrame:
    """``(key, word, n, shorter)``: a word's signatures as the shorter (or equally long) and as the longer word of a pair."""
    halves = []
    for shorter in (True, False):
        m = F.length("word") - (0 if shorter else 1)
        half = (m / 2).cast("int")
        for side, part in ((0, F.substring("word", F.lit(1), half)), (1, F.substring("word", F.length("word") - (m - half) + 1, m - half))):
            halves.append(F.struct(F.xxhash64(m, F.lit(side), part).alias("half"), F.lit(shorter).alias("shorter")))
    rows = words.select("word", "n", _signatures(weight, parts).alias("_signs"), F.explode(F.array(*halves)).alias("_h"))
    rows = rows.select("word", "n", "_h.half", "_h.shorter", F.explode("_signs").alias("_sign"))
    return rows.select(F.xxhash64("_sign", "half").alias("key"), "word", "n", "shorter")


def _verified(rows: DataFrame) -> DataFrame:
    """Near pairs ``(a, an, b, bn)`` among the words that share a key; a pair may come more than once."""
    a = rows.where("shorter").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    b = rows.select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("shorter").alias("_same"))
    near = (F.col("a") != F.col("b")) & (~F.col("_same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(near).select("a", "an", "b", "bn")


def near_pairs(words: DataFrame, parts: int = PARTS, heavy: int = HEAVY) -> DataFrame:
    """All pairs ``(a, an, b, bn)`` of distinct near words of ``words`` (``word``, ``n``), each once."""
    # at most one row for each letter that a word can have
    weight = {r["c"]: r["w"] for r in words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("w")).collect()}
    rows, found = written(_signed(words, weight, parts), "signatures"), []
    while True:
        over = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select("key"), "heavy")
        if parts >= len(weight) or is_empty(over):
            found.append(_verified(rows))
            break
        found.append(_verified(rows.join(over, "key", "left_anti")))
        parts = min(2 * parts, max(len(weight), 3))
        again = rows.join(over, "key").select("key", "word", "n", "shorter", F.explode(_signatures(weight, parts)).alias("_sign"))
        rows = written(again.select(F.xxhash64("key", "_sign").alias("key"), "word", "n", "shorter"), "signatures")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _roots(forms: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(word, root)`` for every word that has a form: pointers are doubled until none moves. Counts grow along
    them, so there are no circles and few steps."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = written(now.join(up, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if is_empty(now.where("_moved")):
            return now.select("word", "root")
    raise RuntimeError("forms did not end")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = DROP_EVERY,
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = 2, parts: int = PARTS, heavy: int = HEAVY) -> DataFrame:
    """One row per word: ``word``, ``form`` (its near word of largest count, ties: smallest, if that count is at least
    ``times`` the word's), ``root`` (where the forms end), ``n``, ``n_near``, ``form_n``."""
    words = written(word_counts(docs, id_col, text_col, drop_every, min_length, min_count), "words")
    pairs = near_pairs(words, parts, heavy)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("m")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    all_ = words.join(near, "word", "left")
    fits = -F.col("_best.m") >= times * F.col("n")
    all_ = written(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("_best.other")).alias("form"),
                               F.when(fits, -F.col("_best.m")).alias("form_n")), "forms")
    roots = _roots(all_.where("form is not null"))
    return (all_.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
