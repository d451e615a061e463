"""Parts of a text: short sentences in front do not use up the places of longer ones."""

from pyspark.sql import functions as F

from evimem.functions import text as T


def test_short_sentences_do_not_count(spark):
    long = [f"This is long sentence {k}." for k in range(8)]
    df = spark.createDataFrame([(0, " ".join(["Yes."] * 7 + long)), (1, "No. Go."), (2, None)], "k int, t string").orderBy("k")
    assert [r[0] for r in df.select(T.parts(F.col("t"))).collect()] == [long[:6], [], []]


def test_parts_keep_their_digits(spark):
    df = spark.createDataFrame([("0 is the first number; 1 is the second number; the last of them is 2",)], "t string")
    assert df.select(T.parts(F.col("t"))).collect()[0][0] == ["0 is the first number", "1 is the second number", "the last of them is 2"]
