"""Stages decide by row: ids may be missing or repeated."""

from flowtables.llm import chunk_dedup


def test_drop_copies_keeps_each_text_of_missing_and_repeated_ids(spark):
    rows = [(None, "a one", "p"), (None, "b two", "q"), (None, "b  two", "q"), (7, "c three", "r"), (7, "d four", "s"), (7, "a one", "p"),
            (3, "d four", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    left = chunk_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    found = sorted((str(r["doc_id"]), " ".join(r["text"].split()), r["lang"]) for r in left.collect())
    assert found == [("3", "d four", "s"), ("7", "a one", "p"), ("7", "c three", "r"), ("None", "b two", "q")]
