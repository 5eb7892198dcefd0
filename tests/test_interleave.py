from pyspark.sql import functions as F

from tillspark.operators import evidence


def test_a_text_that_does_not_fit_is_skipped(spark):
    rows = [("a", 1, "x" * 50), ("a", 2, "four"), ("a", 3, "sevenxx"), ("b", 1, "five5"), ("b", 2, "nine nine"), ("b", 3, ""), ("c", 9, "four"), ("c", 10, "to"), ("c", 11, None)]
    df = spark.createDataFrame(rows, "g string, n int, t string")
    got = [r["t"] for r in evidence.interleave(df, "g", [F.col("n")], "t", 12).collect()]
    assert sorted(got, key=str) == sorted(["five5", "to", "four", "", None], key=str)
