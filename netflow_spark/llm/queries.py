"""Registered queries of the training-data operators (``op<N>_<name>``) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op8_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _spans_sql(kind: str, number: int, pattern: str, test: str) -> str:
    """Spans of a kind from the lengths of what lies between the matches and of the matches."""
    return f"""
  SELECT doc_id, {number} AS number, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda i: struct_pack(
    ok := {test},
    first := coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0),
    size := length(hits[i]))), lambda s: s.ok)) AS s
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {pattern}) AS hits, regexp_split_to_array(coalesce(text, ''), {pattern}) AS gaps FROM documents)"""


_ASSIGN = """'((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""


@query("op9_secret_scan", f"""
WITH spans AS ({_spans_sql("assign", 0, _ASSIGN, f"length(regexp_extract(hits[i], {_ASSIGN}, 2)) >= 6")}
  UNION ALL {_spans_sql("access", 1, "'AKIA[A-Z0-9]+'", "length(hits[i]) >= 20")}
  UNION ALL {_spans_sql("hex", 2, "'[0-9a-f]+'", "length(hits[i]) >= 24")}),
found AS (
  SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
         string_agg(kind || ':' || s.first::BIGINT || ':' || (s.first + s.size)::BIGINT, ',' ORDER BY s.first, number) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import RULES, find_secrets
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == F.lit(r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES]
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return (found.select("doc_id", *counts, joined.alias("spans"))
            .select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans"))


@query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) END AS grams FROM w),
t AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components
    found = jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import url_verdicts
    return url_verdicts(table(spark, sf_dir, "pages"))


@query("op3_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates
    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_license_scan", r"""
WITH known(sentence, id, license) AS (VALUES
  ('released under the mit license', 'mit-name', 'MIT'), ('licensed under the apache license version 2 0', 'apache2-name', 'Apache-2.0'),
  ('this work is licensed under the gnu general public license version 3', 'gpl3-name', 'GPL-3.0-only'),
  ('licensed under cc by nc 4 0', 'ccbync4-name', 'CC-BY-NC-4.0'), ('all rights reserved', 'reserved', NULL)),
rule(license, number) AS (VALUES ('GPL-3.0-only', 1), ('MIT', 2), ('Apache-2.0', 3), ('CC-BY-NC-4.0', 4)),
cut AS (SELECT doc_id, regexp_replace(translate(
    regexp_replace(regexp_replace(coalesce(text, ''), '[.!?;:][ \t\r\n\f]+', chr(1), 'g'), '[ \t\r\f]*\n[ \t\r\n\f]*([^a-z \t\r\n\f])', chr(1) || '\1', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x01\x{80}-\x{10FFFF}]+', ' ', 'g') AS t FROM documents),
part AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS s, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM cut),
hit AS (SELECT doc_id, i, id, license, number FROM part JOIN known ON trim(s) = sentence LEFT JOIN rule USING (license))
SELECT d.doc_id, coalesce(string_agg(id, ',' ORDER BY i), '') AS sentence_ids,
  coalesce((SELECT string_agg(license, ',' ORDER BY number) FROM (SELECT DISTINCT license, number FROM hit h WHERE h.doc_id = d.doc_id AND number IS NOT NULL)), '') AS licenses,
  count(id) FILTER (number IS NULL) AS n_left_over
FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
                        F.size("left_over").cast("long").alias("n_left_over"))


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_components
    return line_components(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepieces import encode_and_decode
    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import new_folder
    from .token_files import read_documents, write_token_files
    path = new_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)


#: CRC-32 in SQL: the table of 256 values and the update with a byte (``crc`` so far, inverted; ``tbl`` the table).
_CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i)))"""


def _crc_sql(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of all levels, and the runs of nodes that have a common parent."""
    return f"""
{name}(tree, level, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM {leaves}
  UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n),
{name}_runs AS (SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _walk_sql(name: str, tree: str, start: str) -> str:
    """From the rows of ``start`` up a tree: the folded digest and the siblings."""
    return f"""
{name}(row, tree, level, pos, folded, siblings) AS (
  SELECT row, tree, 0, pos, folded, siblings FROM {start}
  UNION ALL SELECT row, w.tree, w.level + 1, pos // 8, sha256(array_to_string(hs[1:pos % 8], '') || folded || array_to_string(hs[pos % 8 + 2:], '')),
    siblings || array_to_string(hs[1:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
  FROM {name} w JOIN {tree}_runs r ON w.tree = r.tree AND w.level = r.level AND w.pos // 8 = r.run),
{name}_end AS (SELECT row, arg_max(folded, level) AS folded, arg_max(siblings, level) AS siblings FROM {name} GROUP BY row)"""


@query("op12_merkle_manifest", f"""
WITH RECURSIVE {_CRC_TABLE},
leaf AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS h, {_leaf_sql(_LOWERED)} AS other,
    coalesce({_crc_sql("list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)")} % 3 = 0, false) AS hit
  FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n,
  CASE WHEN hit THEN other ELSE h END AS folded, '' AS siblings FROM leaf),
{_tree_sql("node", "leaves")},
subroots AS (SELECT '' AS tree, tree AS lang, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
{_tree_sql("top", "subroots")},
{_walk_sql("walk", "node", "leaves")},
starts AS (SELECT l.row, '' AS tree, s.pos, w.folded, w.siblings FROM leaves l JOIN walk_end w USING (row) JOIN subroots s ON s.lang = l.tree),
{_walk_sql("climb", "top", "starts")}
SELECT doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = t.h AS verified
FROM leaves l JOIN climb_end c USING (row) JOIN subroots s ON s.lang = l.tree, (SELECT h FROM top WHERE n = 1) t""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import tamper_check
    return tamper_check(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants", rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWERED.replace("text", "coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
marked AS (SELECT run, c, {_crc_sql("list_transform(range(1, strlen(key) + 1), lambda i: ('0x' || substr(hex(key), 2 * i - 1, 2))::BIGINT)")} AS h
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM run), crc_table),
word AS (SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM marked)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
del AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM del a JOIN del b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM del a JOIN word b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM del a JOIN word b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM word w LEFT JOIN best b ON b.word = w.word),
follow(word, root, step) AS (SELECT word, word, 0 FROM form UNION ALL
  SELECT f.word, g.form, step + 1 FROM follow f JOIN form g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT form.word, form, root, n, n_near, form_n FROM form JOIN (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word) r ON r.word = form.word""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"))
