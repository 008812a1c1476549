"""The compression classifier: held-out accuracy, inputs of a score, odd labels."""

import zlib

from pyspark.sql import functions as F

from fleet_audit.llm.compression_quality import fit_quality, score_quality
from fleet_audit.llm.op7_quality import held_out, op7_compression_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = op7_compression_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    rows = scored.select("quality", "predicted", "score").collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = {q: sum(r.predicted == q for r in rows if r.quality == q) / sum(r.quality == q for r in rows) for q in (0, 1)}
    assert right[1] >= 0.9 and right[0] >= 0.5


def test_held_out_rule(spark):
    rows = spark.range(50).withColumn("h", held_out(F.col("id"))).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, "good words here", 9.0), (2, None, 9.0), (3, "", 9.0), (1, "good words here", 9.0), (None, "x" * 70_000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5)], "doc_id long, quality int")
    model = fit_quality(docs, labels, F.lit(True))
    assert model.slope == 0.0
    assert [r.score for r in score_quality(docs, model).collect()] == [0.5] * 5
    assert score_quality(docs.limit(0), model).collect() == []


def test_scores_do_not_depend_on_other_columns(spark):
    docs = spark.createDataFrame([(i, ("fine plain words " if i % 2 else "%%% buy!! ") * 20 + str(i)) for i in range(200)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = fit_quality(docs, labels, F.lit(True))
    a = {r.text: r.score for r in score_quality(docs, model).collect()}
    b = {r.text: r.score for r in score_quality(docs.withColumn("doc_id", -F.col("doc_id")), model).collect()}
    assert a == b and all((s >= 0.5) == ("fine" in t) for t, s in a.items())
