from lakeweave.llm import decontaminate


def test_only_counted_rows_are_broadcast(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"b{i}w{j}" for j in range(15))) for i in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "start " + " ".join(f"b3w{j}" for j in range(10)) + " end"), (2, "nothing of it at all")], "doc_id long, text string")
    seen = []
    small = decontaminate._small
    monkeypatch.setattr(decontaminate, "_small", lambda df, rows: (seen.append((df.count(), rows)), small(df, rows))[1])
    assert {r.doc_id for r in decontaminate.keep(docs, bench).collect()} == {2}
    assert seen and all(n <= rows for n, rows in seen)
