import re
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from cases import groups, shingles
from test_secrets import spans
from tokenizers import Tokenizer

from netflow_spark.llm.common import written
from netflow_spark.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


def masked(text):
    out, at = "", 0
    for start, _, _, end in spans(text):
        if end > at:
            out += text[at:start] + "[SECRET]" if start >= at else ""
            at = end
    return out + text[at:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {}
    for i, t in texts.items():
        last[t] = max(i, last.get(t, i))
    texts = {i: t for i, t in texts.items() if last[t] == i}
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    group = groups(sorted(sets), lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    texts = {i: masked(t) for i, t in texts.items() if group[i] == i}

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, SF), name)
        assert now.columns == docs.columns
    assert {r.doc_id: r.text for r in now.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in now.collect())

    tok, sizes = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
