"""Recall of the benchmark search at the operator's own threshold, for each item length."""

import numpy as np
import pytest

from tillspark.llm import decontaminate

from .conftest import prose


@pytest.mark.parametrize("n", range(1, 65))
@pytest.mark.parametrize("insert_and_drop", [False, True])
def test_recall_at_a_quarter_of_the_words(n, insert_and_drop):
    r = np.random.default_rng(n)
    words = lambda k: r.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    items, docs = [(k, words(n)) for k in range(200)], []
    for _, item in items:
        passage = item.tolist()
        for at in r.choice(n, decontaminate.allowed(n), replace=False)[::-1].tolist():
            kind = r.integers(3) if insert_and_drop else 0
            at = min(at, len(passage) - 1)
            passage[at : at + (kind != 1)] = [] if kind == 2 else words(1).tolist()
        docs.append(np.concatenate([words(20 + r.integers(20)), np.array(passage, dtype=np.uint64), words(30)]))
    found = {(doc, item) for doc, item, *_ in decontaminate.matches(docs, decontaminate.classes_of(items))}
    assert len(found & {(k, k) for k in range(200)}) / 200 >= 0.975


def test_rows_with_null_or_repeated_ids_go_by_their_text(spark):
    items = spark.createDataFrame([(0, prose(700, 30))], "item_id long, text string")
    leak = prose(1, 40) + " " + prose(700, 30)
    docs = spark.createDataFrame([(None, leak), (None, prose(2, 40)), (1, leak), (1, prose(3, 40)), (2, None)], "doc_id long, text string")
    want = {(None, prose(2, 40)), (1, prose(3, 40)), (2, None)}
    assert {tuple(r) for r in decontaminate.decontaminate(docs, items).collect()} == want
