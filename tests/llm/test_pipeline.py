"""The pipeline's stages on a small corpus with planted junk, copies and sources."""

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, prose, rows


def corpus(spark, folder):
    texts, good = [], []
    for i in range(240):
        t = prose(i, 60 + i % 40)
        if i % 6 == 0:
            t = " ".join(w + "###" for w in t.split())
        texts.append(t), good.append(int(i % 6 > 0))
    texts += [texts[1], texts[2] + " one more word", texts[3], None, ""]
    spark.createDataFrame(rows(texts), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts, good


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    folder = str(tmp_path / "sf")
    texts, good = corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, kept = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "packing":
            assert [f.name for f in docs.schema] == [f.name for f in schema] and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.collect()]
    bad = {i for i, g in enumerate(good) if not g}
    assert len(bad & set(kept["quality"])) <= 2 and len(set(range(240)) - bad - set(kept["quality"])) <= 2
    assert set(kept["language"]) == {i for i in kept["quality"] if texts[i] and texts[i].strip()}
    assert set(kept["near_duplicates"]) == set(kept["language"]) - {240, 241, 242}
    assert set(kept["mixing"]) <= set(kept["near_duplicates"]) and max(np.bincount(kept["mixing"])) <= 2
    assert set(kept["packing"]) == set(kept["mixing"])


def test_run_returns_the_last_stage(spark, tmp_path):
    folder = str(tmp_path / "sf")
    corpus(spark, folder)
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(0 <= r["offset"] < 1024 and 0 < r["length"] <= 1024 for r in got)


def test_empty_tables_and_tables_without_labels(spark, tmp_path):
    folder = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    docs = spark.createDataFrame(rows([prose(i, 50) for i in range(6)], ids=[1, 1, -2, None, 4, 5]), SCHEMA)
    assert corpus_pipeline.good_quality(spark, docs, folder).count() == 6
    assert corpus_pipeline.one_of_each(spark, docs, folder).count() == 6
