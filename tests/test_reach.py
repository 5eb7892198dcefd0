from tillspark.operators import graph


def test_long_chains_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(f"{i}", f"{i + 1}", "k") for i in range(70)], "source string, target string, kind string").coalesce(1)
    start = spark.createDataFrame([("0",)], "id string").coalesce(1)
    assert graph.reach(start, edges).agg({"depth": "max"}).head()[0] == 70
    assert graph.reach(start, edges, max_depth=2).count() == 3
