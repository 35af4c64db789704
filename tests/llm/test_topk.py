import math
import random

import pytest

pytest.importorskip("millrace.llm.topk")

import numpy as np  # noqa: E402

from millrace.llm import topk  # noqa: E402


def brute(rows, k=5, step=50):
    good = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in good:
        if q % step == 0:
            best = sorted({(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q})[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("n", [1, 4, 700])
def test_against_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 100)
    monkeypatch.setattr(topk, "GROUP", 4)
    rng = random.Random(n)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # equal vectors: ties
    rows += [(2000, None), (2050, [1.0, None, 2.0]), (2051, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (2100, []), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


def test_tree_invariants():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-50, 50, (200, 8)), rng.integers(100, 106, (400, 8))])
    tree = topk.build(np.arange(600), points)
    assert sorted(tree.ids) == list(range(600))

    def check(node):
        inside = tree.points[node.lo : node.hi]
        assert np.sqrt(((inside - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        if node.children:
            assert [c.lo for c in node.children] == [node.lo, *[c.hi for c in node.children[:-1]]]
            centres = np.array([c.centre for c in node.children if not c.loose])
            gaps = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert gaps[~np.eye(len(centres), dtype=bool)].min(initial=np.inf) > node.radius / 2 - 1e-9
            for c in node.children:
                check(c)

    check(tree.root)


def test_few_products_on_clustered_vectors():
    """In tight clusters most pairs of nodes are passed over."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 8)) * 4000
    points = np.floor(np.repeat(centres, 256, axis=0) + rng.normal(size=(4096, 8)) * 40)
    own = np.arange(0, 4096, 4)
    search = topk.Search(topk.build(own, points[own]), 5).run(topk.build(np.arange(4096), points))
    assert search.products < 0.15 * len(own) * len(points)
    scores = points[own] @ points.T
    scores[np.arange(len(own)), own] = -np.inf
    at = {int(q): i for i, q in enumerate(own)}
    for q, best in zip(search.q.ids, search.best, strict=True):
        want = sorted((-s, i) for i, s in enumerate(scores[at[int(q)]].tolist()))[:5]
        assert best == want


def test_blocks_are_passed_over_and_queries_beyond_the_data_are_answered(spark, monkeypatch):
    """Many blocks in clusters; queries that lie in cells without data; a vec_id that fills a cell with its vectors."""
    import numpy as np

    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "GROUP", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 4)) * 100
    rows = [(int(i), [float(x) for x in centres[i % 8] + rng.normal(size=4)]) for i in range(600)]
    rows += [(7777, [50.0 + i, 1.0, 2.0, 3.0]) for i in range(90)]
    asked = [(10_000 + i, [float(x) for x in rng.normal(size=4) * 500]) for i in range(20)] + rows[:40]
    schema = "vec_id long, embedding array<float>"
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = lambda v: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)
    data = [(i, ints(v)) for i, v in rows]
    for q, v in asked:
        v = ints(v)
        want = sorted((-int(v @ x), i) for i, x in data if i != q)
        want = sorted(set(want))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
