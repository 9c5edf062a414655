"""Secret scans: an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). The ledger holds one row per blob and
rule version with the spans found; a scan reads only pairs the ledger doesn't hold, each distinct
blob once, however many paths have it. Findings are then joined back to all paths,
or to the whole rows, by content.

Texts that can't be repeated (Bloom filter of repeated hashes, see ``exact_dedup``) are scanned where
they are read; of texts that may be, only one copy is scanned. Matches are leftmost and don't
overlap within a rule; matches that fail the rule's length test are used up and dropped.
Positions are code points from 0, ends are exclusive.

Null text is empty text and has no findings. Null ids and repeated rows get their text's findings.
Empty tables give empty results. Only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bloom_words, id_and_text, mark_members, written
from .exact_dedup import content_hash


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; one counts if capture ``group`` of it has at least ``least`` characters."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds of secrets and their order.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # runs of at least so many characters are the runs that pass the length test
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
_SPANS = "array<struct<start:long,end:long>>"


def _blob(text: Column) -> Column:
    return F.unhex(content_hash(text))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule: the lengths of what lies between the matches and of the matches, added up."""
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long")).alias("gap"),
                         F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.struct(
                             F.length(x).cast("long").alias("size"),
                             (F.length(F.regexp_extract(x, rule.pattern, rule.group)) >= rule.least).alias("ok"))).alias("hit"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["hit"]["size"], F.lit(0).cast("long"))
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["hit"]["ok"], F.concat(state["spans"], found)).otherwise(state["spans"]).alias("spans"))

    return F.when(F.regexp_like(text, pattern), F.aggregate(pairs, zero, step, lambda s: s["spans"])).otherwise(F.array().cast(_SPANS))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, rule, spans)`` of every row of ``(blob, _text)`` and every rule."""
    found = F.array(*[F.struct(F.lit(r.key).alias("rule"), rule_spans(F.col("_text"), r).alias("spans")) for r in rules])
    return blobs.select("blob", F.explode(found).alias("_f")).select("blob", "_f.rule", "_f.spans")


def extend_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                  text_col: str = "text", filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` has not seen. Returns the paths ``(_id, blob)`` and the new ledger rows, both written."""
    texts = id_and_text(docs, id_col, text_col).select("_id", _blob(F.col("_text")).alias("blob"), "_text")
    paths = written(texts.select("_id", "blob"), "paths")
    words = written(bloom_words(paths, "blob", filter_bits, repeated=True), "bloom")
    maybe = mark_members(paths, F.col("blob"), words, "_maybe", filter_bits).where("_maybe")
    one = written(maybe.groupBy("blob").agg(F.min("_id").alias("_id")), "representatives")
    marked = mark_members(texts, F.col("blob"), words, "_maybe", filter_bits)
    copies = (marked.where("_maybe").select("_id", "blob", "_text").alias("l")
              .join(one.alias("r"), F.expr("l._id <=> r._id and l.blob = r.blob"), "left_semi")
              .dropDuplicates(["_id", "blob"]))
    blobs = marked.where(~F.col("_maybe")).select("blob", "_text").unionByName(copies.select("blob", "_text"))
    if ledger is None:
        return paths, written(scan(blobs, rules), "ledger")
    parts = []
    for rule in rules:
        seen = ledger.where(F.col("rule") == rule.key).select("blob")
        parts.append(scan(blobs.join(seen, "blob", "left_anti"), (rule,)))
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    return paths, written(new, "ledger")


def _findings(docs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], id_col: str, text_col: str,
              filter_bits: int) -> tuple[DataFrame, DataFrame]:
    """The paths ``(_id, blob)`` and, of every blob with secrets, one row ``(blob, spans)``; both written."""
    paths, new = extend_ledger(docs, ledger, rules, id_col, text_col, filter_bits)
    rows = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "spans"))
    number = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("_number") + 1)
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("_number").alias("number"), kind.alias("kind"), s["end"].alias("end")))
    found = (rows.where(F.size("spans") > 0).withColumn("_number", number).where("_number is not null")
             .select("blob", "_number", spans.alias("spans")).dropDuplicates(["blob", "_number"])
             .groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")))
    # written, so that both sides of the join are shuffled anew and a blob on many paths can be split
    return paths, written(found, "findings")


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Per row of ``docs``: id and ``spans`` (array of start, kind number, kind, end; by start, then rule order)."""
    paths, found = _findings(docs, ledger, rules, id_col, text_col, filter_bits)
    none = F.array().cast("array<struct<start:long,number:int,kind:string,end:long>>")
    return paths.join(found, "blob", "left").select(F.col("_id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
           rules: tuple[Rule, ...] = RULES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with every secret replaced by ``mask`` and ``length_col``, where there is one, kept true.

    Rows meet the findings by their text, whatever their id. Only rows that may have findings (Bloom
    filter of the texts with secrets) are shuffled.
    """
    cols = docs.columns
    _, found = _findings(docs, None, rules, id_col, text_col, filter_bits)
    found = found.select("blob", F.col("spans").alias("_spans"))
    words = written(bloom_words(found, "blob", filter_bits), "bloom")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"),
                        _blob(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("blob"))
    marked = mark_members(whole, F.col("blob"), words, "_hit", filter_bits)
    text = F.col(f"_row.`{text_col}`")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.substring(text, s["at"].cast("int") + 1, F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        out = F.concat(s["out"], before, F.when(x["start"] >= s["at"], F.lit(mask)).otherwise(F.lit("")))
        return F.when(x["end"] <= s["at"], s).otherwise(F.struct(x["end"].alias("at"), out.alias("out")))

    clean = F.aggregate("_spans", zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"].cast("int") + 1, F.lit(2 ** 31 - 1))))
    hits = marked.where("_hit").join(found, "blob", "left").withColumn("_clean", F.when(F.col("_spans").isNull(), text).otherwise(clean))
    out = marked.where(~F.col("_hit")).select("_row", text.alias("_clean")).unionByName(hits.select("_row", "_clean"))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("_clean").alias(c)
        old = F.col(f"_row.`{c}`")
        if c == length_col:
            kind = docs.schema[c].dataType
            return F.when(F.col("_clean").eqNullSafe(text), old).otherwise(F.length("_clean").cast(kind)).alias(c)
        return old.alias(c)

    return out.select(*[column(c) for c in cols])
