from pyspark.sql import functions as F

from tessera.functions.text import char_ngrams, item_text, tokenize, word_ngrams


def _one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    cases = {
        "Zebra zebra ZEBRA quilt": ["zebra", "zebra", "zebra", "quilt"], "rev.7_beta/9x": ["rev", "7", "beta", "9x"], "which was it then": ["which"], "to be, or not": [],
        "q 5 an": ["q", "5"], "": [], None: [], "ﬂat ＭＵＧ": ["flat", "mug"], "½ cup": ["1", "2", "cup"], "naïve café": ["na", "ve", "caf"],
    }
    for text, want in cases.items():
        assert _one(spark, text, tokenize(F.col("text"))) == want


def test_item_text_repeats_fields_by_weight(spark):
    df = spark.createDataFrame([("Kettle", "", "Kitchen", "Tea", "Northwind")], "title string, description string, category string, subcategory string, brand string")
    assert df.select(item_text().alias("x")).first()["x"] == "Kettle Kettle Kettle Kitchen Kitchen Tea Tea Northwind Northwind"
    assert df.select(item_text({"brand": 1, "title": 2, "category": 0}).alias("x")).first()["x"] == "Northwind Kettle Kettle"
    assert spark.createDataFrame([(None, "z")], "title string, description string").select(item_text({"title": 2, "description": 1}).alias("x")).first()["x"] == "z"


def test_ngrams(spark):
    assert _one(spark, "Red big fox", word_ngrams(F.col("text"), 1, 2)) == ["red", "big", "fox", "red big", "big fox"]
    assert _one(spark, "red", word_ngrams(F.col("text"), 1, 3)) == ["red"]
    assert _one(spark, "", word_ngrams(F.col("text"))) == []
    assert _one(spark, "ab", char_ngrams(F.col("text"))) == [" ab", "ab ", " ab "]
    assert _one(spark, "a", char_ngrams(F.col("text"))) == [" a "]
