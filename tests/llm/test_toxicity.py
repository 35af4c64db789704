import random
import zlib

import pytest

pytest.importorskip("millrace.llm.toxicity")

from millrace.llm import toxicity as tox  # noqa: E402


def corpus(n, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeioutnshr", k=rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["grobble", "SNIRK!", "zorkling" + rng.choice("abcdefgh"), "zorkler" + rng.choice("abcdefgh")]))
        rows.append((i, " ".join(words), toxic))
    return rows


def brute_marginals(model, evidence):
    """Sums over all label sequences."""
    import itertools
    import math

    z, on = 0.0, [0.0] * len(evidence)
    for ys in itertools.product((0, 1), repeat=len(evidence)):
        s = model.first * ys[0] + sum((e + model.bias) * y for e, y in zip(evidence, ys, strict=True)) + sum(model.step[a][b] for a, b in zip(ys, ys[1:], strict=False))
        w = math.exp(s)
        z += w
        for i, y in enumerate(ys):
            on[i] += w * y
    return [x / z for x in on]


def test_marginals_are_exact():
    model = tox.Model(bias=-1.2, first=-0.4, step=((0.7, -0.3), (0.2, 0.9)), fitted=True)
    evidence = [0.0, 2.5, 0.0, -1.0, 4.0, 0.3, 0.0]
    want = brute_marginals(model, evidence)
    assert model.marginals(evidence) == pytest.approx(want, abs=1e-12)
    node, pair = tox._expected(model, evidence)
    assert node == pytest.approx(want, abs=1e-12)
    assert sum(map(sum, pair)) == pytest.approx(len(evidence) - 1)


def test_held_out_accuracy_and_spans(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    got = {r.row.doc_id: r.tox for r in tox.scored(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 150
    wrong = sum((got[i].score >= tox.AT_LEAST) != bool(y) for i, _, y in held)
    assert wrong <= 0.03 * len(held)
    for i, text, y in held:
        for s in got[i].spans:
            assert text[s.start : s.end].lower().startswith(("grobble", "snirk", "zorkl"))


def test_cases(spark):
    rows = corpus(300)
    schema = "doc_id long, text string, tox string, score int, row int"
    long = "na " * 60_000
    data = [(r[0], r[1], "x", 1, 2) for r in rows] + [(None, None, "a", 1, 1), (1000, "", "b", 1, 1), (1001, " \n", "c", 1, 1), (1002, long, "d", 1, 1), (1002, long, "d", 1, 1)]
    docs = spark.createDataFrame(data, schema)
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows] + [(None, 0, 1), (3, 0, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = tox.cleaned(docs, labels)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert kept.count(1002) == 2 and kept.count(None) == 1 and {1000, 1001} <= set(kept)
    assert tox.cleaned(docs, labels.limit(0)).count() == len(data)
    assert tox.cleaned(docs.limit(0), labels).count() == 0
    assert tox.Scorer(tox.Model())("anything") == (0.0, [])


def test_runs_of_quiet_tokens_against_all_label_sequences():
    """Chains sums over runs by powers of a matrix; here over each sequence of tags by itself."""
    import itertools
    import math

    import numpy as np

    par, e = np.array([-1.1, 0.3, -0.7, 0.4, 0.2]), np.array([2.0, -0.5])
    docs = [[0, 0, 2, 0, 1], [1], [0], [0, 0, 0, 0], [2, 1, 0, 0, 0, 2, 2], [1, 0]]  # 0: quiet, else a kind and one
    chains = tox.Chains([(np.array(d), i % 2) for i, d in enumerate(docs)], np.array([-1, 0, 1]))
    logz, nodes = chains.logz(np.stack([par, par + 0.1]), e, nodes=True)
    seen = {}
    for i in range(len(chains.sizes)):
        seen[int(chains.sizes[i]), tuple(chains.kinds[i]), tuple(chains.gaps[i])] = i
    for y, d in enumerate(docs):
        kinds = [k - 1 for k in d]
        at = [i for i, k in enumerate(kinds) if k >= 0]
        weigh = lambda ys, p: p[1] * ys[0] + sum((p[0] + (e[k] if k >= 0 else 0)) * t for t, k in zip(ys, kinds, strict=True)) + sum((0, p[2], p[3], p[4])[2 * a + b] for a, b in zip(ys, ys[1:], strict=False))
        all_ = list(itertools.product((0, 1), repeat=len(d)))
        mine = next(i for i in range(len(docs)) if chains.toxic[i] == y % 2 and chains.sizes[i] == len(at) and [k for k in chains.kinds[i] if k >= 0] == [kinds[j] for j in at] and chains.gaps[i].sum() == len(d) - len(at))
        for row, p in enumerate((par, par + 0.1)):
            z = sum(math.exp(weigh(ys, p)) for ys in all_)
            assert logz[row, mine] == pytest.approx(math.log(z), abs=1e-9)
        z = sum(math.exp(weigh(ys, par)) for ys in all_)
        for k, j in enumerate(at):
            assert nodes[mine, k] == pytest.approx(sum(math.exp(weigh(ys, par)) for ys in all_ if ys[j]) / z, abs=1e-9)


def test_quiet_texts_by_length():
    model = tox.Model(weights={"x": 1.0}, bias=-3.0, first=0.2, step=((0.0, -1.0), (-0.5, 0.3)), curve=(0.1, 0.5, 0.7), fitted=True)
    for n in (0, 1, 5, 200, 256, 257, 3000):
        assert model.quiet(n) == pytest.approx(tox._summary(model.marginals([0.0] * n)), abs=1e-9)
    slow = tox.Model(bias=0.0, step=((0.0, -9.0), (-9.0, 0.0)), first=-3.0, fitted=True)  # settles late
    assert slow.quiet(2000) == pytest.approx(tox._summary(slow.marginals([0.0] * 2000)), abs=1e-9)


def test_planted_offsets_and_single_words():
    """Of the planted words nine in ten are found where they stand, and so is the strongest word alone in a long text."""
    rows = corpus(1200, seed=8)
    model = tox.fit([(t, y) for i, t, y in rows if i % 4])
    scorer, planted, hit, extra = tox.Scorer(model), 0, 0, 0
    for i, text, y in rows:
        if i % 4 == 0:
            spans, at = {(s["start"], s["end"]) for s in scorer(text)[1]}, 0
            for w in text.split():
                at, bare = text.index(w, at), w.strip(tox.PUNCTUATION)
                bad = bare.lower().startswith(("grobble", "snirk", "zorkl"))
                planted, hit, extra = planted + bad, hit + (bad and (at, at + len(bare)) in spans), extra + (not bad and (at, at + len(bare)) in spans)
                at += len(w)
    assert planted > 100 and hit >= 0.9 * planted and extra <= 0.05 * planted
    best = max(("grobble", "snirk"), key=lambda w: model.evidence(w))
    text = "aeio utn " * 2000 + best + " shr" * 3000
    score, spans = scorer(text)
    assert score >= tox.AT_LEAST and [text[s["start"] : s["end"]] for s in spans] == [best]


def test_fit_holds_no_words_of_clean_texts():
    """The driver's memory doesn't follow the number of distinct words in the sample."""
    import tracemalloc

    rng = random.Random(5)
    rows = [(f"{t} grobble" if y else t, y) for i in range(1000) for y, t in [(int(i % 10 == 0), " ".join(f"{rng.getrandbits(40):x}" for _ in range(250)))]]
    tracemalloc.start()
    model = tox.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tox.Scorer(model)("one grobble two")[0] >= tox.AT_LEAST > tox.Scorer(model)("one two")[0]
    assert peak < 24e6


def test_places_of_words_in_parts(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    held = [np.array([rng.randint(1, 9) for _ in range(rng.randint(0, 40))], np.uint32) for _ in range(60)]
    plain = {(a, b, c) for x in held for a, b, c in zip([0, *x[:-1].tolist()], x.tolist(), [*x[1:].tolist(), 0], strict=False)}
    want = [sum(b == w for _, b, _ in plain) for w in range(1, 12)]
    assert tox._places(held, 11).tolist() == want
    monkeypatch.setattr(tox, "PLACES", 100)
    assert tox._places(held, 11).tolist() == want
    assert tox._places([], 0).tolist() == []
