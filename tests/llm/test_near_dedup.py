import random

import pytest

pytest.importorskip("millrace.llm.simhash")

from tests_llm_brute import near_copies as brute  # noqa: E402

from millrace.llm import jaccard, simhash  # noqa: E402


def corpus(seed):
    """Unlike texts, some with one passage in common; near copies about the threshold; copies; short texts."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, texts = words(40), []
    for _ in range(25):
        base = words(rng.randint(20, 200))
        texts.append(base + passage * rng.randint(0, 1))
        for _ in range(rng.randint(0, 5)):
            copy = list(texts[-1])
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(copy)
    texts += [words(3), ["A", "b"], ["a", "B"], [], passage, [*passage, "end"]]
    rng.shuffle(texts)
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_near_copies_against_brute_force(spark):
    texts = corpus(3)
    want, near = brute(texts)
    assert near > 20
    got = simhash.near_deduped(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("most", [1, 2])
def test_large_groups_against_brute_force(spark, most):
    texts = corpus(4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = jaccard.shingled(docs).cache()
    rows = simhash.grouped(found.select("doc_id", "fp"), jaccard.links(found, docs, simhash.components, most=most)).collect()
    assert {r.component_id for r in rows} == brute(texts)[0] and len(rows) == len(texts)


def test_pairs_of_sf01_that_differ_in_many_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id IN (547, 7971)")
    assert [r.doc_id for r in simhash.near_deduped(docs).collect()] == [547]
