import hashlib
import random

import numpy as np
import pytest

from tillspark.llm import decontaminate, near_dup, suffix_dedup
from tillspark.llm.components import components

from .conftest import edited, prose


def test_components_match_union_find(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_components(rows):
    sets = {i: frozenset(near_dup.shingles(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a0, b0 = find(a), find(b)
                parent[max(a0, b0)] = min(a0, b0)
    return {i: find(i) for i in ids}


def family(seed, n, words, start):
    """Near copies of one text, from almost equal to just unlike, in chains too."""
    base = prose(seed, words)
    out, last = [], base
    for k in range(n):
        last = edited(base if k % 3 else last, (k % 5) * 0.01, 100 * seed + k)
        out.append((start + k, last))
    return out


@pytest.fixture(scope="module")
def copies():
    rows = [(i, prose(500 + i, 40)) for i in range(60)]
    for k in range(12):
        rows += family(k, 8, 90, 1000 + 50 * k)
    rows += family(77, 150, 120, 5000)  # more than a small node holds
    rows += [(9000 + i, prose(1, 50)) for i in range(120)]  # copies
    rows += [(9500, None), (9501, ""), (9502, "a b"), (9503, "A  b"), (9504, "a b c")]
    return rows


def test_near_duplicates_match_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    out = near_dup.near_duplicates(docs).collect()
    want = brute_components(copies)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("heavy", [near_dup.HEAVY, 0.01, 1.0])
def test_deeper_levels_and_dense_nodes_match_brute_force(spark, copies, monkeypatch, heavy):
    """With nodes of at most four members nearly everything branches on or is dense; all, some or no nodes are heavy."""
    monkeypatch.setattr(near_dup, "SMALL", 4)
    monkeypatch.setattr(near_dup, "HEAVY", heavy)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    out = near_dup.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components(copies)


def test_recall_of_pairs_just_above_the_threshold(spark):
    """As many documents as sf0.1 has: 2,500 pairs with 0.75 to 0.80 of their shingles in common, among 5,000 others."""
    docs, want = [(20_000 + i, prose(50_000 + i, 40)) for i in range(5_000)], set()
    for k in range(2_500):
        base = prose(100_000 + k, 120).replace("\n", " ").split(" ")
        other, x = base[:], set(near_dup.shingles(" ".join(base)).tolist())
        # Words are swapped one by one, each taking up to five shingles, until the pair is near the threshold.
        for at in random.Random(k).sample(range(len(base)), len(base)):
            other[at] = f"swap{k}x{at}"
            y = set(near_dup.shingles(" ".join(other)).tolist())
            if 100 * len(x & y) < 80 * len(x | y):
                break
        if 100 * len(x & y) >= 75 * len(x | y):
            want.add(2 * k + 1)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    assert len(want) > 2_000
    out = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    linked = {r["doc_id"] for r in out.where("not kept").collect()}
    assert linked <= want and len(linked) >= 0.99 * len(want)


def test_a_common_passage_does_not_keep_documents_together(spark, monkeypatch):
    """Half of each document is one passage; pairs differ in two words of the rest, and nothing ends in a dense node."""
    r = random.Random(5)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = own(36), []
    for k in range(900):
        words = passage + own(34)
        rows.append((10 * k, " ".join(words)))
        if k % 6 == 0:
            words[-3], words[-12] = own(2)
            rows.append((10 * k + 1, " ".join(words)))
    met, dense_links = [], near_dup._dense_links
    monkeypatch.setattr(near_dup, "_dense_links", lambda rows, *rest: (met.append(rows.count()), dense_links(rows, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(docs).collect()}
    want = brute_components(rows)
    found = [i for i in want if want[i] != i and got[i] == want[i]]
    assert len(found) >= 0.98 * sum(want[i] != i for i in want) > 140
    assert all(got[i] in (i, want[i]) for i in want)
    assert sum(met) == 0


def test_near_duplicates_of_odd_tables(odd_docs, no_docs):
    out = near_dup.near_duplicates(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[5]["component_id"] == 4 and by[0]["n_shingles"] == 0 and by[0]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dup.near_duplicates(no_docs).collect() == []


def brute_repeats(rows):
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1000, 1 << 20])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    r = random.Random(8)
    shared = [prose(900 + k, 30) for k in range(4)]
    rows = []
    for i in range(40):
        parts = [prose(i, r.randrange(0, 40)), r.choice(shared)[r.randrange(40) : 60 + r.randrange(200)], "é" * r.randrange(0, 130), prose(i % 9, 25)]
        r.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(100, "x" * 350), (101, "x" * 99), (102, "x" * 100), (103, None), (104, ""), (105, rows[3][1]), (106, "ab" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(x) for x in suffix_dedup.remove_repeats(docs, digest=True).collect())
    assert got == brute_repeats(rows)


def test_suffix_dedup_of_odd_tables(odd_docs, no_docs):
    out = suffix_dedup.remove_repeats(odd_docs).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert len(r["kept"]) == r["n_bytes"] - r["n_removed"] and len(r["spans"]) == r["n_spans"]
    assert suffix_dedup.remove_repeats(no_docs, digest=True).collect() == []


def test_cover_meets_every_difference():
    c, v = suffix_dedup.COVER, suffix_dedup.PERIOD
    assert {(a - b) % v for a in c for b in c} == set(range(v))


def levenshtein(item, stretch):
    """Fewest edits between the item and any part of the stretch."""
    row = [0] * (len(stretch) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(stretch, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_closest_is_the_edit_distance():
    r = random.Random(2)
    for _ in range(300):
        item, stretch = ([r.randrange(1, 4) for _ in range(r.randrange(1, 9))] for _ in range(2))
        stretch = stretch * r.randrange(0, 3)
        edits, a, b = decontaminate.closest(np.array(item, dtype=np.uint64), np.array(stretch, dtype=np.uint64))
        assert edits == levenshtein(item, stretch) and 0 <= a <= b <= len(stretch)


def test_leaks_recall_and_precision(spark):
    r = random.Random(12)
    items = [(k, prose(700 + k, r.randrange(15, 60))) for k in range(40)] + [(90, None), (91, ""), (92, "zq vx")]
    docs, want = [(i, prose(i, 120)) for i in range(80)], set()
    for n, (k, text) in enumerate(items[:40]):
        doc = 1000 + n
        passage = edited(text.replace("\n", " "), (n % 5) * 0.04, n).upper() if n % 2 else text
        docs.append((doc, prose(2000 + n, 50) + " " + passage + " " + prose(3000 + n, 45)))
        want.add((doc, k))
    docs += [(5000, None), (5001, ""), (None, items[0][1]), (5002, "so zq vx it"), (1000, docs[80][1])]
    want |= {(None, 0), (5002, 92)}
    out = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in out.collect()} == want


def test_leaks_of_odd_tables(odd_docs, no_docs, spark):
    items = spark.createDataFrame([(1, prose(2, 200)[:300]), (None, "x y z")], "item_id long, text string")
    assert [x["doc_id"] for x in decontaminate.find_leaks(odd_docs, items).collect()] == [7]
    assert decontaminate.find_leaks(no_docs, items).collect() == []
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).collect() == []
    assert decontaminate.decontaminate(odd_docs, items).count() == odd_docs.count() - 1


def test_members_of_a_passage_meet_by_their_other_tokens(spark, monkeypatch):
    """Half of each document is one passage: no node below the root is needed to find the pairs among them."""
    r = random.Random(6)
    own = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = own(36), []
    for k in range(400):
        words = passage + own(34)
        rows.append((10 * k, " ".join(words)))
        if k % 4 == 0:
            words[-3], words[-12] = own(2)
            rows.append((10 * k + 1, " ".join(words)))
    made, put = [], near_dup._Tables.put
    monkeypatch.setattr(near_dup._Tables, "put", lambda tables, df, name: (made.append((name, out := put(tables, df, name), out.count())), out)[1])
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = brute_components(rows)
    found = [i for i in want if want[i] != i and got[i] == want[i]]
    assert len(found) >= 0.98 * sum(want[i] != i for i in want) > 95
    assert all(got[i] in (i, want[i]) for i in want)
    below = [n for name, _, n in made if name == "path-rows"][1:]
    assert sum(below) < len(rows)
