import numpy as np
from cases import AWKWARD, docs

from netflow_spark.llm.quality import keep_good, quality_scores

LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").toPandas()
    assert (rows["quality"] == rows["predicted"]).mean() > 0.97
    assert ((rows["score"] - rows["quality"]) ** 2).mean() < 0.03


def test_held_out_is_crc32_of_the_id(spark):
    import zlib
    got = quality_scores(docs(spark, AWKWARD), spark.createDataFrame([], LABELS)).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    assert len(got) == len(AWKWARD)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.score == 0.5 and r.predicted == 1


def test_null_labels_and_copies(spark):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 0, "x"), (3, None, None, None), (None, 0, 0, "x"), (5, 0, 0, "x")], LABELS)
    got = quality_scores(docs(spark, AWKWARD), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_learnt(spark):
    import zlib
    data = [(i, "good words here" if i % 2 else "bad!!! $$$ ###") for i in range(1, 60)]
    out = [i for i, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(i, i % 2, 0, "") for i, _ in data]
    wrong = [(i, (1 - i % 2) if i in out else i % 2, 0, "") for i, _ in data]
    a, b = ({r.doc_id: r.score for r in quality_scores(docs(spark, data), spark.createDataFrame(x, LABELS)).collect()} for x in (right, wrong))
    assert a == b


def test_keep_good_keeps_columns(spark):
    df = docs(spark, AWKWARD)
    got = keep_good(df, spark.createDataFrame([], LABELS))
    assert got.columns == df.columns and got.count() == len(AWKWARD)
    assert keep_good(docs(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_max_train_bounds_the_fitted_rows(spark, monkeypatch):
    """Repeated ids and more labels than ``max_train``: no more rows reach the driver."""
    from netflow_spark.llm import quality
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, vectors: seen.append((len(x), len(y))) or quality.Model(
        vectors, *[np.zeros(quality.WIDTH)] * 2, np.zeros((quality.WIDTH, 4)), *[np.zeros(4)] * 2, 0.0, 1.0))
    rows = docs(spark, [(1, f"word{i} and more") for i in range(300)] + [(i, f"other {i}") for i in range(2, 400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400)], "doc_id long, quality int")
    quality.train(rows, labels, max_train=10)
    quality.train(rows, labels.where("doc_id < 3"), max_train=10)
    assert all(a == b for a, b in seen) and 1 <= seen[0][0] <= 10 and seen[1][0] <= 2
