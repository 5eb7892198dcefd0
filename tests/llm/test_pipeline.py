"""The pipeline against the same steps in plain Python, and its behaviour on odd tables."""

import random
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillspark.llm import quality_rules
from tillspark.llm.line_dedup import MIN_SITES
from tillspark.llm.queries import QUERIES, vocabulary_path

from .conftest import edited, prose
from .test_line_dedup import brute as without_boilerplate
from .test_pairs import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    items = [(k, prose(700 + k, 30)) for k in range(6)]
    docs, labels = [], []
    for i in range(160):
        text = prose(i, 60) + "\nSubscribe to our letter." * (i % 3 > 0)
        if i % 8 == 5:
            text = " ".join(w + r.choice(["###", "%%%", "&&&"]) for w in text.split(" "))
        docs.append((i, text, "en", f"src{i % 20}", len(text)))
        labels.append((i, int(i % 8 != 5), 0))
    docs += [(300 + k, edited(docs[k][1], 0.02, k), "en", "src1", 0) for k in range(0, 40, 10)]
    docs += [(400 + k, prose(900 + k, 40) + "\n" + items[k][1] + "\n" + prose(950 + k, 40), "en", "src2", 0) for k in range(3)]
    docs += [(500, None, None, None, None), (501, "", "en", "src1", 0), (502, "too short", "en", "src1", 9)]
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs


def test_matches_plain_python(spark, folder):
    from tokenizers import Tokenizer

    root, docs = folder
    crf = quality_rules.train(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    good = [(i, t, s) for i, t, _, s, _ in docs if not quality_rules.counts(t)[-1] and quality_rules.content_share(t, crf) >= quality_rules.MIN_CONTENT]
    assert {i for i, _, _ in good} == {i for i, *_ in docs if i < 500 and (i % 8 != 5 or i >= 300)}
    texts = without_boilerplate(good, MIN_SITES, sys.maxsize)
    assert sum(t.split("\n").count("Subscribe to our letter.") for t in texts.values()) == 1
    component = brute_components(list(texts.items()))
    kept = {i: t for i, t in texts.items() if component[i] == i and not 400 <= i < 403}
    assert len(kept) == len(texts) - 4 - 3
    library = Tokenizer.from_file(vocabulary_path())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept.items()}
    out = corpus_pipeline.run(spark, root).collect()
    assert {r["doc_id"]: r["token_ids"] for r in out} == want and all(r["n_tokens"] == len(r["token_ids"]) for r in out)


def test_stages_keep_the_columns_and_their_values(spark, folder):
    root, rows = folder
    docs = spark.read.parquet(f"{root}/documents.parquet").withColumns({"kept": F.lit("mine"), "n_removed": F.lit(7), "doc": F.col("doc_id"), "body": F.lit("b"), "_1": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.schema == docs.schema, name
        assert 100 < out.count() <= len(rows), name
        assert out.where("kept <> 'mine' or n_removed <> 7 or body <> 'b' or not doc <=> doc_id").count() == 0, name
        assert stage(spark, docs.limit(0), root).collect() == [], name


def test_near_duplicates_of_null_and_repeated_ids(spark, folder):
    root, _ = folder
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(None, a, "x"), (None, a, "x"), (None, edited(a, 0.02, 1), "x"), (7, b, "x"), (7, c, "x"), (7, c, "y"), (7, edited(c, 0.02, 2), "x"), (8, b, "x"), (9, a, "z"), (None, None, "x"), (None, "", "x")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), root).collect()
    assert sorted((r["doc_id"] is None, r["text"] in (None, ""), r["text"] or "") for r in out)[0][0] is False
    assert {(r["doc_id"], r["text"]) for r in out if r["text"] in (a, b)} == {(9, a), (7, b)}
    assert len(out) == 5 and sum(r["doc_id"] == 7 for r in out) == 2 and sum(r["text"] in (None, "") for r in out) == 2


def test_every_operator_has_its_query():
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 11)] == [1] * 10


def test_queries_of_pairs_and_models_run_on_the_tables(spark, folder):
    root, docs = folder
    for name in ("op2_toxicity", "op5_quality_rules", "op7_quality_classifier", "op8_bpe"):
        assert QUERIES[name](spark, root).count() == len(docs), name
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontamination"](spark, root).collect()} == {(400, 0), (401, 1), (402, 2)}
