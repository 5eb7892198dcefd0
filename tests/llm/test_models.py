import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.llm import quality_mil, quality_rules, toxicity
from tillspark.llm.common import crc_fold

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        text, toxic, good = prose(i, 80), i % 4 == 0, i % 5 != 0
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vilewort", "hatelump", "scumbrute"]))
            text = " ".join(words)
        if not good:
            text = " ".join(w + r.choice(["###", "%%%", "&&&"]) for w in text.split(" "))
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, prose(3, 40)), (5, docs[5][1])]
    labels += [(2000, 1, 1), (None, 0, 0), (7, 0, 0), (1000, None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("model", "label"), [(toxicity, "toxic"), (quality_mil, "quality")])
def test_held_out_accuracy(labelled, model, label):
    docs, labels = labelled
    held = crc_fold(F.col("doc_id"), 3) == 1
    fitted = model.train(docs, labels, label, ~held)
    scored = model.score(docs, fitted)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    right = scored.where(held).join(labels.where("doc_id <> 7"), "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).head()[0]
    assert right > 0.93


@pytest.mark.parametrize(("model", "label"), [(toxicity, "toxic"), (quality_mil, "quality")])
def test_odd_tables(odd_docs, no_docs, spark, model, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    fitted = model.train(odd_docs, none, label)
    assert {round(r["score"], 6) for r in model.score(odd_docs, fitted).collect()} == {0.5}
    assert model.score(no_docs, fitted).collect() == []


def test_features_cover_whole_texts():
    long = prose(1, 9000)
    assert len(np.setdiff1d(toxicity.features(long + " zebrafinch quux"), toxicity.features(long))) > 0
    assert len(quality_mil.passages(long)) == 180
    assert quality_mil.passages(None).shape == quality_mil.passages("").shape == (1, quality_mil.N_FEATURES)


def brute_repeats(words, width=8):
    seen = {}
    for i in range(len(words) - width + 1):
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + width)})


def test_repeated_words_match_brute_force():
    r = random.Random(3)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randrange(0, 60))]
        assert quality_rules.repeated_words(words) == brute_repeats(words)


def test_counts():
    text = "one two\nthree\none two\n \n\x0b\nx# é%\xa0y"
    assert quality_rules.counts(text) == (7, 23, 2, 1, 0, True)
    assert quality_rules.counts(None) == quality_rules.counts("") == (0, 0, 0, 0, 0, True)


def test_viterbi_matches_brute_force():
    r = np.random.default_rng(2)
    from itertools import product

    for _ in range(50):
        crf = quality_rules.LineCRF(r.normal(size=(2, len(quality_rules.FEATURES))), r.normal(size=(2, 2)))
        x = r.normal(size=(5, len(quality_rules.FEATURES)))
        e = x @ crf.emit.T

        def worth(states, e=e, crf=crf):
            return sum(e[t, s] for t, s in enumerate(states)) + sum(crf.move[a, b] for a, b in zip(states, states[1:], strict=False))

        assert tuple(crf.decode(x)) == max(product((0, 1), repeat=5), key=worth)


def test_quality_rules_keep_prose_and_drop_junk(labelled, odd_docs, no_docs, spark):
    docs, labels = labelled
    crf = quality_rules.train(docs, labels)
    out = quality_rules.judge(docs, crf).join(labels.where("doc_id <> 7"), "doc_id")
    assert out.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).head()[0] > 0.98
    untaught = quality_rules.train(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    judged = quality_rules.judge(odd_docs, untaught)
    assert judged.count() == odd_docs.count() and judged.where("kept is null").count() == 0
    assert quality_rules.judge(no_docs, crf).collect() == []
