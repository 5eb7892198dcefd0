import random

import pytest

VOCAB = [f"{a}{b}" for a in ("ba", "re", "ti", "no", "lu", "sha", "ker", "mon") for b in ("", "la", "tin", "dor", "sel", "pax")]


def prose(seed: int, words: int, per_line: int = 12) -> str:
    r = random.Random(seed)
    picked = [r.choice(VOCAB) + r.choice(VOCAB) for _ in range(words)]
    return "\n".join(" ".join(picked[i : i + per_line]).capitalize() + "." for i in range(0, words, per_line))


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for i in r.sample(range(len(words)), int(share * len(words))):
        words[i] = f"swap{r.randrange(10**6)}"
    return " ".join(words)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, near copies, and columns that operators also use inside."""
    long_text = prose(99, 6000)
    texts = [None, "", " \n\t ", "one two", prose(1, 60), prose(1, 60), edited(prose(1, 60), 0.03, 5), prose(2, 200), long_text, long_text + "\nThe end.", prose(3, 60), "a b c d e f g h " * 40, "¡Ünïcode ΑΣ 字 😀! " * 20]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), i, "x") for i, t in enumerate(texts)]
    rows += [rows[4], (None, prose(4, 50), None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
