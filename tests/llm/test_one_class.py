"""The quality stage with labels that nothing can be learned from."""

import corpus_pipeline


def test_labels_of_one_class_reject_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "p", 6) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 40
