"""Sentences are counted without taking the text apart, as parts between dots that are not blank."""

from foliant.operators import classify


def test_sentence_count_in_one_pass(spark):
    texts = ["", ".", " . ", "a", "a.", "a. b", "a..b", ".  .　x y. \n", " .", "...a b...c. \t", "\U0001d11e.\x1c.z"]
    want = [0, 0, 0, 1, 1, 2, 2, 1, 0, 2, 2]
    df = classify.text_features(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t")
    assert [r["sentence_count"] for r in df.orderBy("i").collect()] == want
