import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("millrace.llm.lm_score")

from millrace.llm import lm_score  # noqa: E402

SCHEMA = "doc_id long, text string, score string, n int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(rows, order):
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [words(t) for d, t in rows if not out(d)]
    unigrams = Counter(w for ws in train for w in ws)
    n, v = sum(unigrams.values()) + len(train), len(unigrams) + bool(train)
    trie = {}
    read = lambda ws: b"\n" * order + " ".join(ws).encode() + b"\n"
    for ws in train:
        raw = read(ws)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                trie.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    result = []
    for d, t in rows:
        ws, raw, score = words(t), read(words(t)), 0.0
        for i in range(order, len(raw)):
            gone = set()
            for k in range(order, -2, -1):
                if k < 0:
                    score += math.log10(1 / (256 - len(gone)))
                    break
                left = {b: c for b, c in trie.get(raw[i - k : i], {}).items() if b not in gone}
                if left:
                    if raw[i] in left:
                        score += math.log10((2 * left[raw[i]] - 1) / (2 * sum(left.values())))
                        break
                    score += math.log10(len(left) / (2 * sum(left.values())))
                    gone |= left.keys()
        base = sum(math.log10((unigrams[w] + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        result.append((d, out(d), len(ws) + 1, sum(unigrams[w] > 0 for w in ws) + bool(train), n, base, score))
    return result


@pytest.mark.parametrize(("order", "head"), [(2, 10), (5, 100_000)])
def test_against_brute_force(spark, order, head):
    rng = random.Random(order)
    some = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(80)]
    rows = [(i, " ".join(rng.choices(some, k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t X"), (None, "Abc abc"), (3, rows[3][1]), (14, "zq zq " * 3000), (203, "\x00 漢字 \x1c")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, lm_score.scores(df, order, head, head).collect()), key=str)
    want = sorted(brute(rows, order), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one():
    nodes = [([1, 2], [3, 1]), None, ([1, 2, 3, 200], [5, 1, 2, 1])]
    assert sum(10 ** lm_score.escaped(nodes, b) for b in range(256)) == pytest.approx(1)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(2, "a"), (2, None)], "doc_id long, text string")
    assert lm_score.scores(df.limit(0)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_score.scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.n_known, row.train_tokens, row.base_score) == (0, 0, 0.0) and row.score == pytest.approx(3 * math.log10(1 / 256))
