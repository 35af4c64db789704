import random

import pytest

pytest.importorskip("millrace.llm.simhash")

from tests_llm_brute import components as brute_components  # noqa: E402
from tests_llm_brute import fingerprint as brute_fingerprint  # noqa: E402

from millrace.llm import simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_query_against_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_components(fps)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


@pytest.mark.parametrize("group", [8, 4096])
def test_links_of_dense_and_sparse_fingerprints(spark, group):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    for _ in range(120):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    pairs = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), len(fps), group)).collect()
    got = {}
    for r in pairs:
        got.setdefault(r.root, {r.root}).add(r.node)
    want = {}
    for i, r in brute_components(dict(enumerate(fps))).items():
        want.setdefault(r, set()).add(signed[i][0])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    nodes = rng.sample(range(10_000), 300)
    df = spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long")
    got = {(r.node, r.root) for r in simhash.components(df).collect()}
    assert got == {(n, min(nodes)) for n in nodes if n != min(nodes)}


def test_cases(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    schema = "doc_id long, text string, fp string, component_id int, key string"
    rows = [(5, None, "x", 1, "a"), (3, "", "y", 2, "b"), (4, " \n\t", "z", 3, "c"), (None, "a b", "n", 4, "d"), (7, long, "l", 5, "e"), (6, long + " more", "m", 6, "f"), (9, "one two", "p", 7, "g"), (9, "one two", "p", 7, "g")]
    docs = spark.createDataFrame(rows, schema)
    kept = simhash.near_deduped(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3], rows[5], rows[6]], key=str)
    empty = docs.limit(0)
    assert simhash.near_deduped(empty).count() == 0
    assert simhash.fingerprint(long.encode()) & (2**64 - 1) == brute_fingerprint(long)


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, x) for x in range(500, 900)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root if find(x) != x}
