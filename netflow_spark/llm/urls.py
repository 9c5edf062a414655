"""URL filters: rules first, gradient-boosted trees on lexical features for the rest. DataFrame functions and Spark ML only.

A rule fits its host and all subdomains of it if the url's path starts with the rule's; the longest
rule wins. Urls that a rule decides are the labelled ones; a bounded sample of them (``max_train``,
of each label by itself and weighted by the labels' shares in all, so that a rare label isn't missed)
trains the trees on length, depth, digit ratio, character entropy, parameter counts and, for the
host's last label and last two labels, how often labelled urls with it are blocked. Suffix
statistics cover all labelled urls and leave the url's own label out.

Null urls and urls without ``://`` have an empty host and path and are judged like any other. With no
labelled url every verdict is ``allow``; if all have one label, that is the verdict. Repeated rows
are judged alike. Only the id and the url are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


# The rules that decide.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def with_rule(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``rule`` and ``ruled`` (its verdict) to rows with ``host`` and ``path``; null if no rule fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        name = F.when(fits, F.lit(r.host + r.path)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return urls.withColumn("rule", name).withColumn("ruled", verdict)


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")


def lexical_features() -> dict[str, Column]:
    """Features of a row with ``url``, ``host`` and ``path``; none is null."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    chars = F.array_distinct(F.split(url, ""))

    def one(total: Column, c: Column) -> Column:
        p = (size - F.length(F.replace(url, c, F.lit("")))) / F.greatest(size, F.lit(1))
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": size.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/"), "labels": _count(F.col("host"), "."),
        "digit_ratio": digits / F.greatest(size, F.lit(1)), "hyphens": _count(url, "-"),
        "entropy": F.when(size > 0, F.aggregate(chars, F.lit(0.0), one)).otherwise(0.0),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "values": _count(query, "="),
        "fragment": url.contains("#").cast("double"), "https": url.startswith("https://").cast("double"),
    }


_SUFFIXES = {"suffix1": 1, "suffix2": 2}


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url",
                 max_train: int = 20_000, trees: int = 20, depth: int = 3) -> DataFrame:
    """Per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict`` and ``by`` (rule or model)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), url.alias("url"), F.coalesce(host_of(url), F.lit("")).alias("host"), path_of(url).alias("path"))
    rows = with_rule(rows, rules)
    feats = lexical_features()
    rows = rows.withColumns(feats | {s: F.substring_index("host", ".", -k) for s, k in _SUFFIXES.items()})
    rows = written(rows.withColumn("label", (F.col("ruled") == "block").cast("double")).drop("url"), "urls")
    labelled = rows.where("label is not null")
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    keep = [F.col("_id").alias(id_col), "host", "path", "rule"]
    if n == 0 or blocked in (0, n):
        constant = F.lit("block" if n and blocked else "allow")
        return rows.select(*keep, F.coalesce("ruled", constant).alias("verdict"), F.when(F.col("rule").isNull(), "model").otherwise("rule").alias("by"))
    # share of blocked urls by host suffix, drawn towards the overall share; written, so that a common suffix can be split
    mean = blocked / n
    for s in _SUFFIXES:
        stats = written(labelled.groupBy(s).agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_b")), s)
        own = F.coalesce(F.col("label"), F.lit(0.0))
        others = F.coalesce(F.col("_n"), F.lit(0)) - F.col("label").isNotNull().cast("int")
        rate = (F.coalesce(F.col("_b"), F.lit(0.0)) - own + 10 * mean) / (others + 10)
        rows = rows.join(stats, s, "left").withColumns({f"{s}_rate": rate, f"{s}_seen": F.log1p(F.greatest(others, F.lit(0)).cast("double"))}).drop("_n", "_b")
    columns = [*feats, *[f"{s}_{k}" for s in _SUFFIXES for k in ("rate", "seen")]]
    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(rows)
    total = {0.0: n - blocked, 1.0: blocked}
    # half of the sample for either label; what one doesn't need the other takes
    cap = {x: max(1, max_train // 2, max_train - total[1.0 - x]) for x in total}
    limit = {x: int(min(1.0, cap[x] / total[x]) * (1 << 40)) for x in total}
    part = F.pmod(F.xxhash64("_id", "host", "path"), F.lit(1 << 40)) < F.when(F.col("label") == 1.0, F.lit(limit[1.0])).otherwise(F.lit(limit[0.0]))
    train = written(rows.where("label is not null").where(part).select("label", "_features"), "train")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    for x in total.keys() - counts.keys():  # few distinct urls may all miss the sample
        some = written(rows.where(F.col("label") == x).select("label", "_features").limit(int(cap[x])), "train")
        train, counts[x] = train.unionByName(some), some.count()
    weight = {x: total[x] / counts[x] * sum(counts.values()) / n for x in total}
    train = train.withColumn("_weight", F.when(F.col("label") == 1.0, F.lit(weight[1.0])).otherwise(F.lit(weight[0.0])))
    model = GBTClassifier(labelCol="label", featuresCol="_features", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=7, predictionCol="_block").fit(train)
    judged = model.transform(rows)
    return judged.select(*keep, F.coalesce("ruled", F.when(F.col("_block") == 1.0, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("rule").isNull(), "model").otherwise("rule").alias("by"))
