import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import minmax_dedup, secret_scan

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect_in_order(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = sentence(20)
    docs, toxic = [], {}
    for i in range(400):
        text = sentence(60) + "."
        toxic[i] = int(i % 4 == 0)
        docs.append((i, text.replace("w1 ", "") + " grottybeast" * (2 * toxic[i]), "en", "src0", 0))
    clean = [i for i in range(400) if not toxic[i]]
    held = set()
    for i in clean[:10]:
        docs[i] = (i, docs[i][1] + " " + item, "en", "src0", 0)
        held.add(i)
    copies = {i: clean[50] for i in clean[51:71]}
    for i, k in copies.items():
        docs[i] = (i, docs[k][1], "en", "src0", 0)
    spied = clean[100]
    docs[spied] = (spied, docs[spied][1] + " token = abcdefabcdef1234", "en", "src0", 0)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    left = set(toxic)
    for (name, stage), gone in zip(corpus_pipeline.STAGES, [{i for i in toxic if toxic[i]}, set(copies), held, set(), set()]):
        frame = stage(spark, frame, str(tmp_path))
        left -= gone
        assert {x["doc_id"] for x in frame.select("doc_id").collect()} == left, name
        if name != "pieces":
            assert frame.columns == columns
        if name == "secrets":
            masked = frame.filter(f"doc_id = {spied}").first()
            assert secret_scan.PLACEHOLDER in masked["text"] and masked["n_chars"] == len(masked["text"])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(run.collect()) == sorted(frame.collect())
    assert minmax_dedup.classes(spark.read.parquet(f"{tmp_path}/documents.parquet")).filter("NOT kept").count() == len(copies)


def test_every_stage_bears_odd_rows(spark, tmp_path, odd_documents, no_documents):
    spark.createDataFrame([(1, 0), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no such passage anywhere"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = {"near_duplicates": 2}  # the two copies of the first text
    bare = odd_documents.select("doc_id", "text")
    for frame, some in ((odd_documents, True), (odd_documents.withColumn("n_chars", F.lit(7)), True), (bare, True), (no_documents, False)):
        given = frame
        for name, stage in corpus_pipeline.STAGES:
            before, columns = frame.count(), frame.columns
            frame = stage(spark, frame, str(tmp_path))
            assert frame.count() == before - (gone.get(name, 0) if some else 0), name
            if name != "pieces":
                assert frame.columns == columns and frame.drop("n_chars").exceptAll(given.drop("n_chars")).count() == 0
            if name == "secrets" and some and "n_chars" in columns:
                assert {r["n_chars"] for r in frame.filter("text IS NULL").collect()} == {7}
