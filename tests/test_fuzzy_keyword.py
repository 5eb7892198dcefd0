"""I8 against a direct Python version, with keywords of several words."""

import difflib
import random
import re

from tillspark.functions import fuzzy

KEYWORDS = [("organic whole milk", "Dairy"), ("Milk-Powder", "Baking"), ("dish soap", "Cleaning"), ("hand soap bar", "Bath"), ("ring", "Jewellery"), ("bolt", "Hardware"), ("belt", "Clothes"), ("extra large free range eggs", "Eggs")]


def normal(x):
    return re.sub("[^a-z0-9]+", " ", x.lower()).strip()


def direct(text):
    tokens = normal(text).split()
    pieces = {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)} | {normal(text)}
    best = {category: 0.0 for _, category in KEYWORDS}
    for keyword, category in KEYWORDS:
        kw = normal(keyword)
        for piece in pieces - {""}:
            a, b = piece.split(), kw.split()
            if len(a) == len(b) == 1 and piece[0] != kw[0]:
                continue
            prefixes = [{t[:3] for t in x if len(t) >= 3} for x in (a, b)]
            near = prefixes[0] & prefixes[1] or set(a) & set(b) or piece in kw or kw in piece
            best[category] = max(best[category], difflib.SequenceMatcher(None, piece, kw).ratio() - (0 if near else 0.18))
    (category, first), (_, second) = sorted(best.items(), key=lambda x: -x[1])[:2]
    return category if first >= 0.75 and first - second >= 0.08 else None


def test_matches_direct_python(spark):
    r = random.Random(4)
    texts = ["0rganic whole milk", "rganic whole milc 2l", "bish soap", "organik whol mlk", "brng", "rink", "bolt belt", "xtra large free range eggs 12", "xang zoap", "", "?"]
    for _ in range(400):
        text = list(" ".join(r.sample(["new", "blue", "12"], r.randrange(3)) + [r.choice(KEYWORDS)[0]] + r.sample(["pack", "x"], r.randrange(2))))
        for _ in range(r.randrange(4)):
            text[r.randrange(len(text))] = r.choice("aeio0 rk")
        texts.append("".join(text))
    items = spark.createDataFrame([(t,) for t in texts] + [(None,)], "name string")
    out = fuzzy.fuzzy_keyword(items, spark.createDataFrame(KEYWORDS, "keyword string, category string"), "name")
    want = {t: direct(t) for t in texts}
    assert {x["name"]: x["category"] for x in out.collect()} == {t: c for t, c in want.items() if c}
    assert want["0rganic whole milk"] == "Dairy" and want["brng"] is None
