import random

from tillspark.llm import bpe
from tillspark.llm.queries import vocabulary_path

from .conftest import prose


def texts():
    r = random.Random(4)
    letters = [chr(c) for c in (0x1C, 0x85, 0xA0, 0x200B, 0x3A3, 0x130, 0xDF, 0x301, 0x65, 0xFB01, 0x4E2D, 0x1F600, 0, 9, 10, 39, 115, 32, 32, 49, 0x661, 0xB2, 36, 0x3B1, 97, 98, 104, 108, 108, 0xC9, 0x17F, 0x1C5)]
    made = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    return ["", "Hello <|endoftext|> x<|startoftext|>", "abab" * 100, "abcabc" * 30, "don't WE'LL 'S", prose(1, 500), *made]


def test_matches_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    want = [e.ids for e in library.encode_batch(texts(), add_special_tokens=False)]
    own = bpe.WordBPE(vocabulary_path())
    assert [x.tolist() for x in own.encode_batch(texts())] == want
    assert own.decode_batch(want) == library.decode_batch(want, skip_special_tokens=False)


def test_lower_rank_made_on_the_way_comes_first():
    """A merge may make a pair of a lower rank; the word then waits for it."""
    own = bpe.WordBPE(vocabulary_path())
    ids = {c: i for i, c in enumerate("abcdexyz")}
    own.merges = {(ids["a"], ids["b"]): (5, 10), (10, ids["a"]): (1, 11)}
    own._symbols = lambda w: [ids[c] for c in w]
    assert own.merge_words(["abab", "ab", "abaab"]) == [[11, 1], [10], [11, 10]]


def test_odd_tables(odd_docs, no_docs):
    path = vocabulary_path()
    coded = bpe.decode(bpe.encode(odd_docs, path), path)
    rows = coded.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["token_ids"] == [] and r["decoded"] == "" for r in rows if not (r["text"] or "").strip())
    assert bpe.encode(no_docs, path).collect() == []
