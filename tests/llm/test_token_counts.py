import random

import pytest

pytest.importorskip("millrace.llm.token_counts")

import public_tokenizers  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import bpe, token_counts  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def agree(counter, library, texts):
    want = [(len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts]
    assert counter.counts(texts) == want


def test_counts_equal_the_library(counter, library):
    rng = random.Random(4)
    alpha = "ab cdé'sréllvmt \n\t 19²!?.,<|endoftext|>  ñ漢字🙂 x  \x1c\x85"
    texts = ["", " ", "   ", "a\n", "\n\n x", "it's we'll 've 'r 'rex !'s", "<|endoftext|>", "x<|endoftext|> y", "a" * 3000, " " * 700, "ab" * 2000, "<|endoftext", "'"]
    texts += ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 80))) for _ in range(1000)]
    # Chunks without a blank, so that heads wait for heads.
    texts += ["".join(rng.choice("abcdefgh'rel" + " " * (i % 2)) for _ in range(rng.randint(200, 3000))) for i in range(60)]
    agree(counter, library, texts)
    for t in texts[:40]:
        agree(counter, library, [t])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(max_size=30), max_size=4))
def test_any_text(counter, library, texts):
    agree(counter, library, texts)


def test_compiled_anew(library):
    small = token_counts.Counter(bpe.vocabulary(), states=50)
    for t in ("one two three four", "five six seven", "one two three four"):
        agree(small, library, [t])


def test_query_and_cases(spark, library):
    got = {r.doc_id: r for r in token_counts.query(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(library.encode(d.text, add_special_tokens=False).ids)
        assert tuple(got[d.doc_id]) == (d.doc_id, len(d.text.encode()), n, n > 512)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "x y " * 60_000, 0), (3, "x y " * 60_000, 0)], "doc_id long, text string, n_tokens int")
    out = sorted(map(tuple, token_counts.counted(docs, bpe.vocabulary()).collect()), key=str)
    long = (3, 240_000, len(library.encode("x y " * 60_000, add_special_tokens=False).ids), True)
    assert out == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, False), long, long], key=str)
    assert token_counts.counted(docs.limit(0), bpe.vocabulary()).count() == 0


def test_pairs_that_stay_against_merging():
    """The walk down both sides of a seam against merging the two tokens' text."""
    voc = bpe.vocabulary()
    merger, rng = token_counts.Merger(voc), random.Random(9)
    made = sorted({i for i in merger.ends if i >= 0})
    short = [i for i in made if len(voc.token[i]) <= 3]
    pairs = [(rng.choice(s), rng.choice(s)) for s in (made, short) for _ in range(4000)]
    for c in b"aeots -=.0":
        same = [i for i in made if set(voc.token[i]) == {c}]
        pairs += [(a, b) for a in same for b in same]
    for a, b in pairs:
        assert merger._stays(a, b) == (bpe.merge_word(voc, voc.token[a] + voc.token[b]) == [a, b])


def test_odd_strings_and_newest_letters(counter, library):
    from test_pieces import FIXED, strings

    some = [*FIXED, *strings(20_000, 7)]
    for at in range(0, len(some), 4000):
        agree(counter, library, some[at : at + 4000])


def test_long_unbroken_texts_are_quick(counter, library):
    """Chunks without a blank go side by side: a megabyte of letters, and characters of three bytes."""
    import time

    rng = random.Random(10)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(100_000)), "ab" * 200_000, " " * 50_000, "\n \n" * 20_000):
        began = time.process_time()
        got = counter.counts([text])
        assert time.process_time() - began < 40
        assert got == [(len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))]


def test_the_bound_on_states_holds_within_a_call(library, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", 2000)
    small, rng = token_counts.Counter(bpe.vocabulary(), states=3000), random.Random(11)
    small.numbers = 9000
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé漢 ") for _ in range(n)) for n in (10, 30_000, 200, 60_000)] + ["<|endoftext|>".join(["x" * 50, "漢字" * 4000, ""])]
    agree(small, library, texts)
    assert len(small.state) <= 9000
