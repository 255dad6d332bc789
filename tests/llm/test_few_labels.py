from pyspark.sql import functions as F

from lakeweave.llm import toxicity


def test_few_labels_give_a_score_that_tells_kinds_apart(spark, tiny):
    docs, labels = spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").groupBy("toxic").agg(F.avg("score").alias("s"), F.countDistinct("score").alias("n"))
    by = {int(r.toxic): r for r in got.collect()}
    assert by[0].n > 1 and by[1].s > by[0].s + 0.3


def test_a_sample_has_one_row_a_key_and_bounded_texts(spark):
    from lakeweave.llm.labelled import sample

    docs = spark.createDataFrame([(1, "a" * 100)] * 500 + [(1, "b")] * 500 + [(i, "c" * 100) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 30).collect()
    assert len(got) == len({r.k for r in got}) <= 30 and all(r.y == r.k % 2 for r in got)
    few = sample(docs, labels, "toxic", 30, most_bytes=1000).collect()
    assert 0 < len(few) < len(got) and sum(len(r.text) for r in few) <= 1000
