import pytest
from pyspark.sql import functions as F

from tillspark.llm.queries import BLOCKED_HOSTS, URL_RULES
from tillspark.llm.url_filter import build_cascade, candidate_keys, filter_urls, key_table


def judged(spark, urls, **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = filter_urls(pages, URL_RULES, key_table(spark, BLOCKED_HOSTS), **options)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out.orderBy("page_id").collect()]


def test_rules_and_default(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "http://a.example.net/de/", "http://example.com/de/", "http://example.com/de", "http://x.org/fr/#", "http://notorg/fr/", "https://m.adult-x.example.net", "http://spam-farm.example.com/es/", "http://net", "a://b.net//c://d"]
    assert judged(spark, urls) == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("a.example.net", "/de/", "net/", "block"),
        ("example.com", "/de/", "example.com/de/", "block"),
        ("example.com", "/de", None, "allow"),
        ("x.org", "/fr/", "org/fr/", "allow"),
        ("notorg", "/fr/", None, "allow"),
        ("m.adult-x.example.net", "", None, "block"),
        ("spam-farm.example.com", "/es/", None, "block"),
        ("net", "", None, "allow"),
        ("b.net", "//c://d", "net/", "block"),
    ]
    assert judged(spark, []) == []


def test_segments_give_the_same(spark):
    urls = ["http://a.example.net/en/1", "http://b.example.com/de/2", "http://casino-win.example.net", "http://q.org/fr/x"]
    assert judged(spark, urls, segments=3) == judged(spark, urls)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("host"), "id", F.lit("/")).alias("key"))
    listed = universe.where("key like '%7/'")
    cascade = build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = universe.select("key", cascade.holds(F.col("key")).alias("in")).where("in").select("key")
    assert got.exceptAll(listed).isEmpty() and listed.exceptAll(got).isEmpty()


def test_size_bound_and_bad_rules(spark):
    with pytest.raises(ValueError, match="over the bound"):
        build_cascade(spark.range(1000).select(F.col("id").cast("string").alias("key")), spark.range(5000).select(F.col("id").cast("string").alias("key")), max_filter_bytes=64)
    with pytest.raises(ValueError, match="slash"):
        filter_urls(spark.createDataFrame([], "url string"), [("block", "net/x")], key_table(spark, []))


def test_candidates_longest_first(spark):
    row = spark.range(1).select(candidate_keys(F.lit("a.b.c"), F.lit("/x/y"), 2, 3).alias("k")).head()
    assert row["k"] == ["b.c/x/", "b.c/", "c/x/", "c/"]


def test_a_long_list_is_exact(spark):
    """120,000 listed hosts, packed in blocks."""
    listed = spark.range(120_000).select(F.concat(F.lit("h"), F.col("id") * 3, F.lit(".example.com")).alias("key"))
    pages = spark.range(9_000).select(F.concat(F.lit("http://www.h"), F.col("id") * 41, F.lit(".example.com/x")).alias("url"), "id")
    out = filter_urls(pages, URL_RULES[:1], listed)
    assert out.where((F.col("verdict") == "block") != ((F.col("id") * 41 % 3 == 0) & (F.col("id") * 41 < 360_000))).count() == 0
