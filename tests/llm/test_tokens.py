import random
import zlib
from hashlib import sha256

import pytest

pytest.importorskip("millrace.llm.bpe")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import bpe, token_files  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_tokens int, start string"
ROWS = [(3, "a b", 1, "x"), (1, None, 1, "y"), (2, "", 1, "z"), (None, " \n it's ", 1, "n"), (5, "<|endoftext|> x", 1, "s"), (4, "lorem ipsum, " * 9000, 1, "l"), (3, "a b", 1, "x"), (6, "x" * 30_000, 1, "u")]


def texts(seed=1, n=1500):
    rng = random.Random(seed)
    alpha = "ab cdé'sréllvmt \n\t 19²!?.,<|endoftext|>  ñ漢字🙂 ́ΑΣ\x1c\x85 x"
    fixed = ["", " ", "  ", "it's we'll 've 'r 'rex !'s", "<|endoftext|>", "x<|startoftext|> y", "a" * 3000, " " * 99, "<|endoftext", "ab" * 2000]
    return fixed + ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def voc():
    return bpe.vocabulary()


def test_byte_ids_equal_the_library(voc, byte_library):
    codec, some = bpe.Codec(voc, most=300), texts()
    for at in range(0, len(some), 200):
        for t, ids in zip(some[at : at + 200], codec.encode(some[at : at + 200]), strict=True):
            want = byte_library.encode(t, add_special_tokens=False).ids
            assert ids == ",".join(map(str, want))
            assert codec.decode(ids) == byte_library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    codec = test_round_trip.__dict__.setdefault("codec", None) or bpe.Codec(bpe.vocabulary())
    test_round_trip.codec = codec
    assert codec.decode(codec.encode([text])[0]) == text


def test_trees_agree(voc):
    words = [t.encode() for t in texts(2, 400)]
    assert bpe.merge_words(voc, words) == [bpe.merge_word(voc, w) for w in words]


def test_query8(spark, byte_library):
    got = {r.doc_id: r for r in bpe.query(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = byte_library.encode(d.text, add_special_tokens=False).ids
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == sha256(d.text.encode()).hexdigest()


def test_cases8(spark, voc):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = bpe.encoded(docs, voc).collect()
    assert len(out) == len(ROWS) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert bpe.encoded(docs.limit(0), voc).count() == 0
    more = bpe.with_tokens(docs)
    assert more.columns == [*docs.columns, "token_ids"] and more.filter("doc_id = 2").first().token_ids == []


def test_word_ids_equal_the_library(word_library):
    encode, some = token_files.Encoder(token_files.read_definition(public_tokenizers.path("word_bpe_49k.json"))), texts()
    for t, ids in zip(some, encode([t.encode() for t in some]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == word_library.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_give_random_access(ids, data):
    shard = token_files.Shard(token_files.pack(ids))
    for i in range(0, len(ids), 37):
        assert shard.get(i) == ids[i]
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert shard.slice(a, b).tolist() == ids[a:b]


def check7(got, rows, library):
    start = 0
    want = []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_query7(spark, word_library):
    check7(token_files.query(spark, SF).collect(), [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()], word_library)


def test_cases7(spark, word_library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 3)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    definition = token_files.read_definition(public_tokenizers.path("word_bpe_49k.json"))
    token_files.write(docs, definition, str(tmp_path / "t"))
    check7(token_files.documents(spark, str(tmp_path / "t")).collect(), [r[:2] for r in ROWS], word_library)
    token_files.write(docs.limit(0), definition, str(tmp_path / "e"))
    assert token_files.documents(spark, str(tmp_path / "e")).count() == 0


def test_token_ids_of_rows(spark, byte_library):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for r in bpe.with_tokens(docs).collect():
        assert r.token_ids == byte_library.encode(r.text or "", add_special_tokens=False).ids
