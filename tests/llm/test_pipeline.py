import random

import corpus_pipeline
from lectern.llm import near_dups


def test_stages(spark, tmp_path, edges):
    random.seed(9)
    vocabulary = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    item = prose(30)
    rows = [(i, prose(80), "en", "s", 9) for i in range(120)] + [(i, "junk " * 80, "en", "s", 9) for i in range(120, 150)]
    rows += [(200, rows[3][1], "en", "s", 9), (201, prose(30) + " " + item + " " + prose(20), "en", "s", 9),
             (202, prose(60) + " password=abcdef123", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {*range(120), 202}
    masked = corpus_pipeline.secret_stage(spark, docs, str(tmp_path)).filter("doc_id = 202").first()
    assert masked.text.endswith(corpus_pipeline.MASK) and masked.n_chars == len(masked.text)
    assert masked.asDict().keys() == set(docs.columns)


def test_edges(spark, edges):
    docs = corpus_pipeline.near_dedup_stage(spark, edges, "")
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2, 3, 4, 7]
    assert corpus_pipeline.secret_stage(spark, edges, "").count() == 8


def test_near_dedup_takes_five_words(spark):
    """One word of 47 changed: 40 of 48 four-word sets are common (0.833), 38 of 48 five-word sets (0.792)."""
    words = [f"w{i}" for i in range(47)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20] + ["other"] + words[21:]))],
                                 "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {1, 2}
    assert near_dups.near_documents(docs, size=4).filter("kept").count() == 1
