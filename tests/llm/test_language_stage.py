"""The language stage and the model's bounds."""

from flowtables.llm import language_id

SCHEMA = "doc_id long, text string, lang string"


def test_the_stage_keeps_texts_with_letters_without_any_label(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, None, None), (3, "12 !", None), (4, "der Hund", None)], SCHEMA)
    left = language_id.drop_unidentified(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 4]


def test_copies_do_not_thin_the_sample(spark):
    rows = [(k, f"word{k} other{k}", "en") for k in range(100)] + [(k, "a copy", "en") for k in range(100, 2000)]
    assert language_id.sampled(spark.createDataFrame(rows, SCHEMA), 200).count() == 101


def test_languages_share_the_model_equally(spark):
    rows = [("en", f"e{k}", 100) for k in range(20)] + [("zu", f"z{k}", 2) for k in range(20)] + [("de", "d", 2), ("de", "once", 1)]
    kept = language_id._commonest(spark.createDataFrame(rows, "lang string, w string, n long"), 11).collect()
    assert sorted(r["lang"] for r in kept) == ["de"] + ["en"] * 5 + ["zu"] * 5
