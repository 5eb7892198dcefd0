import sys

from tillspark.llm.line_dedup import dedup_lines

from .conftest import prose
from .test_line_dedup import brute


def test_long_lines_are_boilerplate_too(spark):
    passage = prose(77, 60, per_line=60)
    assert len(passage) > 300
    rows = [(i, "\n".join([prose(i, 24), passage, "x" * (300 + i)]), f"s{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got == brute(rows, 12, sys.maxsize)
    assert sum(passage in t for t in got.values()) == 1
