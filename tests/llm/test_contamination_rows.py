"""Removal of documents: each row goes by its own text."""

from loomgraph.llm import contamination


def test_rows_without_id_or_with_one_in_common(spark):
    item = " ".join(f"word{i}" for i in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item, 1), (None, "clean", 2), (None, None, 3), (5, item, 4), (5, "clean", 5), (5, item, 6), (6, "clean", 7), (7, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id long").withColumn("id", contamination.F.lit(0)).withColumn("row_key", contamination.F.lit(0))
    left = contamination.remove_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["bad_id"] for r in left.collect()) == [2, 3, 5, 7, 8]
    assert contamination.remove_documents(docs.limit(0), bench).collect() == []
    assert contamination.remove_documents(docs, bench.limit(0)).count() == len(rows)
