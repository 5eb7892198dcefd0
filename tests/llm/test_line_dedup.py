from collections import defaultdict

from tillspark.llm.line_dedup import dedup_lines

from .conftest import prose


def brute(rows, min_sites, max_chars):
    sites, first = defaultdict(set), {}
    for doc, text, site in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        for pos, raw in enumerate(text.split("\n")):
            line = raw.strip("\t\n\v\f\r ")
            if line and len(line) <= max_chars:
                sites[line] |= {site} - {None}
                first.setdefault(line, (doc, pos))
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = {}
    for doc, text, _ in rows:
        kept = None if text is None else "\n".join(raw for pos, raw in enumerate(text.split("\n")) if raw.strip("\t\n\v\f\r ") not in bad or first[raw.strip("\t\n\v\f\r ")] == (doc, pos))
        out[doc] = kept
    return out


def test_matches_brute_force(spark):
    rows = []
    for i in range(60):
        lines = prose(i, 30).split("\n") + [f"Shared by {i % 7} and more."] * (i % 7 > 2) + ["Everywhere!", "  Everywhere! "] + ["x" * 400]
        rows.append((i, "\n".join(lines), f"s{i % 9}"))
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n\n \n", "s3"), (None, "Everywhere!\nonly here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs, min_sites=5, max_chars=300).collect()}
    assert got == brute(rows, 5, 300)


def test_odd_tables(odd_docs, no_docs):
    out = dedup_lines(odd_docs, min_sites=2)
    assert out.count() == odd_docs.count()
    assert out.columns == [*odd_docs.columns, "n_lines", "n_removed"]
    assert out.where("text is null").count() == 1
    assert dedup_lines(no_docs).collect() == []


def test_no_python_in_the_plan(odd_docs):
    plan = dedup_lines(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
