"""Ids of odd strings against the library, reads of single ids, and what the workers remember."""

import json
import random

import pytest

pytest.importorskip("millrace.llm.pieces")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from millrace.llm import bpe, common, pieces, token_files  # noqa: E402

#: Letters that lower-case or compose oddly, code points of the newest Unicode versions, white space beyond ASCII.
ODD = "İıßΣςﬁ̇́ͅǅẞ\U000323b0ᲉꟋа漢각각 \u0085 　  \u001c٣²Ⅷ🙂‍﻿"
COMMON = "aAbsStTvVeErRlLmMdD  '''  ..,!?\n\t\r\"()-_|<>9"


def strings(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(ODD if rng.random() < 0.25 else COMMON) for _ in range(rng.randint(0, 14)))


FIXED = ["İ.", "Dİ, son", "GALERİ.", "x İ!", "ȧ.", "word<|endoftext|>'s x", "  <|endoftext|>  y", "a  b", "a  b", "\U000323b0's", "Ᲊ'll go", "Ɤ've", "word's, 'tis", "\r\n\r\nx", " ", ""]


def test_word_ids_of_odd_strings():
    encode, library = token_files.Encoder(token_files.read_definition(public_tokenizers.path("word_bpe_49k.json"))), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    some = [*FIXED, *strings(20_000, 1)]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert encode.apart and [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in some])] == want


def test_byte_ids_of_odd_strings():
    codec, library = bpe.Codec(bpe.vocabulary()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = [*FIXED, *strings(20_000, 2)]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    got = codec.encode(some)
    assert [[int(x) for x in t.split(",")] if t else [] for t in got] == want
    assert [codec.decode(x) for x in got] == some


def test_another_definition_gets_whole_texts():
    own = json.loads(token_files.read_definition(public_tokenizers.path("word_bpe_49k.json"))) | {"normalizer": None}
    encode, library = token_files.Encoder(json.dumps(own)), Tokenizer.from_str(json.dumps(own))
    some = list(strings(500, 3))
    assert not encode.apart and [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in some])] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_other_vocabularies_are_refused(tmp_path):
    own = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()) | {"normalizer": {"type": "NFC"}}
    (tmp_path / "own.json").write_text(json.dumps(own))
    with pytest.raises(ValueError):
        bpe.Vocabulary.read(str(tmp_path / "own.json"), public_tokenizers.PATTERN)


def test_one_codec_for_each_definition():
    made = [common.remembered(key, list, [key]) for key in ("a", "b", "b")]
    assert made == [["a"], ["b"], ["b"]] and made[1] is made[2]


def test_pieces_are_the_text():
    texts = pa.array([t.encode() for t in strings(3000, 4)] + [b"", None], pa.binary())
    distinct, places, firsts = pieces.pieces(pieces.binary(texts))
    whole = distinct.take(places).to_pylist()
    assert [b"".join(whole[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)] == [t or b"" for t in texts.to_pylist()]


def test_memory_is_bounded():
    memory, rng = pieces.Memory(50), random.Random(5)
    for _ in range(200):
        keys = list({str(rng.randint(0, 99)) for _ in range(20)}) + ["x" * 100]
        assert memory.known(keys, lambda ks: [k + "!" for k in ks]) == [k + "!" for k in keys]
        assert len(memory.young) <= 50 and len(memory.old) <= 50 and "x" * 100 not in memory.young


def test_one_id_from_a_file(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and one more of them, " * 40) for i in range(3000)], "doc_id long, text string").coalesce(1)
    definition, path = token_files.read_definition(public_tokenizers.path("word_bpe_49k.json")), str(tmp_path / "t")
    token_files.write(docs, definition, path)
    shards = spark.read.parquet(path).select("part", "shard", "n_ids", "levels").collect()
    assert len(shards) > 4
    rng = random.Random(6)
    for row in rng.sample(shards, 4):
        ids = token_files.Shard([tuple(x) for x in row.levels]).slice(0, row.n_ids)
        for i in (0, row.n_ids - 1, rng.randrange(row.n_ids)):
            assert token_files.token(spark, path, row.part, row.shard, i) == ids[i]
    # The bytes stand as they are, and the filter on the shard leaves one page, of one row.
    file = next(f for f in sorted((tmp_path / "t").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows > 1)
    group = pq.ParquetFile(file).metadata.row_group(0)
    for c in range(group.num_columns):
        column = group.column(c)
        assert column.compression == "UNCOMPRESSED" and not any("DICTIONARY" in e for e in column.encodings)
    one = spark.read.parquet(str(file)).filter("shard = 1").select("levels")
    one.collect()
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() == 1
