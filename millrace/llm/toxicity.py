"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so the tags of tokens are latent: a clean document has clean tokens only, a toxic one has a toxic
token at least, and which it is, the two-state chain (clean, toxic) finds by maximum likelihood of the labels. With Z the
sum over all tag sequences, where the clean sequence weighs 1, a document is clean with probability 1 / Z; the gradient
for a token of a toxic document is its marginal given that not all tokens are clean, less its marginal. Emissions have
features: words and word beginnings that stand in toxic training documents and in hardly any clean ones; which of them
matter, and how much, the chain learns. Tokens without features share one emission, so runs of them are powers of one
2 x 2 matrix and whole texts are fitted, of any length.

For a document the forward-backward marginals give each token's probability; their largest and their sum go through a
logistic curve, fitted on the same sample, to the document's score. Offending spans (code-point offsets) are the tokens
with evidence of their own that are over one half, and in a document that scores AT_LEAST the most probable of them in
any case.

The fit takes at most SAMPLE toxic and CLEAN_TIMES * SAMPLE clean labelled documents, chosen by hash of their id, whole, and
of these as many in that order as have SAMPLE_CHARS characters together; these bounds are the documented parameters of the
classifier. All of them are fitted, in ROUNDS rounds of gradient ascent at most, whatever their number. Scoring reads
every whole text.

Defined cases: null and empty texts, and those of white space, have no tokens: their score is that of a document
without evidence. Labels that repeat a doc_id count as toxic if one does; null labels are left out. Without toxic or
without clean training rows every score is 0. Held out are rows whose crc32 of the id as text is 2 modulo 4; a null id
is not held out. Rows that repeat are scored alike. Other columns pass through `scored` whatever their names.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, ship, stored

#: Most toxic documents in the training sample, and the clean ones for each of those.
SAMPLE, CLEAN_TIMES = 2000, 3
#: A score from here on means toxic.
AT_LEAST = 0.3
BEGINNINGS = (4, 5, 6)
PUNCTUATION = string.punctuation + "“”„«»…¿¡"
#: Most characters of the training sample, toxic and clean each; rounds of gradient ascent; weight of the ridge.
SAMPLE_CHARS, ROUNDS, RIDGE = 64_000_000, 100, 0.02
#: Words of toxic documents whose neighbours are counted at a time, about; the kind of a word without features.
PLACES, NONE = 250_000, -1
#: Most words with evidence that a worker remembers; tokens after which marginals have settled; marginals that add nothing.
REMEMBERED, SETTLED, FEW = 100_000, 128, 0.05


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(word: str) -> list[str]:
    word = word.strip(PUNCTUATION)
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)] if word else []


@dataclass
class Model:
    """weights: of the evidence; bias: of every token; step[a][b]: from state a to b; first: of state 1 at the start."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    first: float = 0.0
    step: tuple = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple = (0.0, 0.0, 0.0)
    fitted: bool = False

    def evidence(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))

    def marginals(self, evidence: list[float]) -> list[float]:
        """Forward-backward: the probability of the toxic state for each token."""
        (a, b), (c, d) = [[math.exp(x) for x in row] for row in self.step]
        ahead, ratio = [], 0.0
        for i, e in enumerate(evidence):  # ratio of the forward sums, toxic to clean
            own = math.exp(min(60.0, e + self.bias))
            ratio = own * (math.exp(self.first) if not i else (b + d * ratio) / (a + c * ratio))
            ahead.append(ratio)
        back, out = 1.0, [0.0] * len(evidence)
        for i in range(len(evidence) - 1, -1, -1):
            odds = ahead[i] * back
            out[i] = odds / (1 + odds)
            own = math.exp(min(60.0, evidence[i] + self.bias)) * back
            back = (c + d * own) / (a + b * own)
        return out

    def quiet(self, n: int) -> tuple[float, float]:
        """The summary of n tokens without evidence. Their marginals settle from both ends; what is between is alike."""
        some = self.marginals([0.0] * min(n, 2 * SETTLED))
        if n > 2 * SETTLED and abs(some[SETTLED - 1] - some[SETTLED]) > 1e-12:  # they have not settled
            return _summary(self.marginals([0.0] * n))
        return _summary(some, max(0, n - 2 * SETTLED) * (some[SETTLED] if n > 2 * SETTLED and some[SETTLED] > FEW else 0.0))

    def score(self, summary: tuple[float, float]) -> float:
        if not self.fitted:
            return 0.0
        at, x, y = self.curve
        most, total = summary
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, at + x * most + y * total))))


def _summary(marginals: list[float], more: float = 0.0) -> tuple[float, float]:
    """Log odds of the largest marginal, and the log of one more than the sum of those over FEW."""
    most = min(max(marginals, default=0.0), 1 - 1e-9)
    return max(-8.0, math.log(max(most, 1e-9) / (1 - most))), math.log1p(more + sum(p for p in marginals if p > FEW))


def fit(docs: Iterable[tuple[str, int]], rounds: int = ROUNDS) -> Model:
    """The model from (text, toxic) pairs."""
    docs = list(docs)
    return _fit(lambda: (t for t, y in docs if y), lambda: (t for t, y in docs if not y), rounds)


def _fit(toxic_texts: Callable[[], Iterable[str]], clean_texts: Callable[[], Iterable[str]], rounds: int = ROUNDS) -> Model:
    """The model from toxic and from clean texts, each read twice: for the counts that choose the features, and for the
    places of the words that have chosen ones. All words are held of toxic texts only, and only while they are counted.
    In toxic documents a word counts once for each pair of neighbours that it stands between, so copies of one document,
    whose words all share a fate, count as one."""
    n_toxic, toxic = _often(toxic_texts())
    often = max(3, 0.004 * n_toxic)
    n_clean, clean = 0, Counter()
    for t in clean_texts():
        n_clean += 1
        clean.update({f for w in set((t or "").lower().split()) for f in features(w) if f in toxic})
    if not n_toxic or not n_clean:
        return Model()
    lift = lambda f: math.log((toxic[f] + 0.5) / n_toxic) - math.log((clean[f] + 0.5) / n_clean)
    chosen = {f for f, k in toxic.items() if clean[f] <= 0.02 * k and lift(f) > math.log(20)}
    # A beginning says nothing of its own if all but few of its words are one chosen word.
    for f in [f for f in chosen if f[0] != "^"]:
        chosen -= {b for b in features(f)[1:] if b in chosen and toxic[b] - toxic[f] < often}
    del toxic, clean
    sets: dict[tuple, int] = {}
    starts = {f.removeprefix("^")[: BEGINNINGS[0]] for f in chosen}  # one of these is how a word with features begins

    def kind(word: str) -> int:
        if word.strip(PUNCTUATION)[: BEGINNINGS[0]] not in starts:
            return NONE
        fs = tuple(sorted(f for f in features(word) if f in chosen))
        return sets.setdefault(fs, len(sets)) if fs else NONE

    held = [(_sparse([kind(w) for w in (t or "").lower().split()]), y) for y, texts in ((0, clean_texts), (1, toxic_texts)) for t in texts()]
    return _train(held, chosen, list(sets), rounds)


def _often(texts: Iterable[str]) -> tuple[int, Counter]:
    """The number of toxic texts, and the counts of their frequent features."""
    import numpy as np

    number: dict[str, int] = {}
    held = [np.array([number.setdefault(w, 1 + len(number)) for w in (t or "").lower().split()], np.uint32) for t in texts]
    out: Counter = Counter()
    for w, k in zip(number, _places(held, len(number)).tolist(), strict=True):
        for f in features(w):
            out[f] += k
    return len(held), Counter({f: k for f, k in out.items() if k >= max(3, 0.004 * len(held))})


def _places(held: list, n_words: int):
    """Between how many pairs of neighbours each word, numbered from 1, stands in the documents; some words at a time."""
    import numpy as np

    out, parts = np.zeros(1 + n_words, np.int64), 1 + sum(map(len, held)) // PLACES
    for part in range(parts if held else 0):
        before, own, after = [], [], []
        for x in held:
            at = np.flatnonzero(x % parts == part)
            around = np.concatenate([[0], x, [0]]).astype(np.uint64)  # beyond the ends stands no word, 0
            before.append(around[at])
            own.append(around[at + 1])
            after.append(around[at + 2])
        half = np.uint64(32)
        pairs, pair = np.unique(np.concatenate(before) << half | np.concatenate(own), return_inverse=True)
        found = np.unique(pair.astype(np.uint64) << half | np.concatenate(after))
        out += np.bincount((pairs[(found >> half).astype(np.int64)] & np.uint64(2**32 - 1)).astype(np.int64), minlength=len(out))
    return out[1:]


def _sparse(kinds: list[int]) -> tuple:
    """The length of a document, where in it words with features stand, and their kinds."""
    import numpy as np

    kinds = np.array(kinds, np.int64)
    at = np.flatnonzero(kinds != NONE)
    return len(kinds), at, kinds[at]


def _dense(sparse: tuple):
    """The kinds of all words of a document."""
    import numpy as np

    n, at, kinds = sparse
    out = np.full(n, NONE, np.int64)
    out[at] = kinds
    return out


class Chains:
    """Documents as the chain sees them: the kinds of their tokens with features, and the runs of others between.

    logz(par, e): log Z of each document for each row of par (bias, first, steps 0-1, 1-0, 1-1; step 0-0 is 0), where e
    is the evidence of each kind."""

    def __init__(self, held: list, kind_of) -> None:
        import numpy as np

        docs = []
        for x, y in held:
            kinds = kind_of[x]
            at = np.flatnonzero(kinds >= 0)
            gaps = np.diff(np.concatenate([[-1], at, [len(x)]])) - 1
            docs.append((len(at), kinds[at], gaps, y))
        # Documents without features differ by length alone.
        plain = Counter((int(g[0]), y) for k, _, g, y in docs if not k)
        docs = sorted((d for d in docs if d[0]), key=lambda d: -d[0])
        docs += [(0, np.zeros(0, int), np.array([n]), y) for n, y in plain if n]
        self.times = np.array([1.0] * (len(docs) - len([1 for n, _ in plain if n])) + [float(c) for (n, _), c in plain.items() if n])
        self.toxic = np.array([bool(d[3]) for d in docs])
        self.sizes = np.array([d[0] for d in docs])
        width = int(self.sizes.max(initial=0))
        self.kinds, self.gaps = np.full((len(docs), width), -1), np.zeros((len(docs), width + 1), int)
        for i, (k, kinds, gaps, _) in enumerate(docs):
            self.kinds[i, :k], self.gaps[i, :k] = kinds, gaps[:-1]
            self.gaps[i, -1] = gaps[-1]  # the last run stands in the last column

    @staticmethod
    def power(q, g):
        """The 2 x 2 matrices q (of each row of parameters) to the powers g, over the larger eigenvalue to that power, and its log."""
        import numpy as np

        a, b, c, d = q
        root = np.sqrt((a - d) ** 2 + 4 * b * c)
        one, two = (a + d + root) / 2, (a + d - root) / 2
        r = np.power(two / one, g)
        out = [((a - two) - r * (a - one)) / root, b * (1 - r) / root, c * (1 - r) / root, ((d - two) - r * (d - one)) / root]
        return out, g * np.log(one)

    def logz(self, par, e, nodes: bool = False):
        """log Z (rows of par x documents); with nodes also the marginals at tokens with features, for the first row."""
        import numpy as np

        bias, first, s01, s10, s11 = (par[:, [i]] for i in range(5))
        up, u01, u10, u11 = np.exp(bias), np.exp(s01), np.exp(s10), np.exp(s11)
        quiet = (np.ones_like(up), u01 * up, u10, u11 * up)
        n, width = self.kinds.shape
        v0, v1, scale = np.ones((len(par), n)), np.exp(first + bias) * np.ones(n), np.zeros((len(par), n))
        live = np.searchsorted(-self.sizes, -np.arange(width), side="left")
        ahead = []

        def run(v0, v1, g):
            (a, b, c, d), log = self.power(quiet, g)
            return v0 * a + v1 * c, v0 * b + v1 * d, log

        for k in range(width):
            m = live[k]
            own, g = np.exp(np.minimum(60.0, e[self.kinds[:m, k]] + bias)), self.gaps[:m, k]
            x0, x1 = v0[:, :m], v1[:, :m]
            x0, x1, log = run(x0, x1, np.maximum(g - 1, 0) if not k else g)
            y0, y1 = x0 + x1 * u10, (x0 * u01 + x1 * u11) * own
            if not k:  # the very first token
                y0, y1 = np.where(g > 0, y0, 1.0), np.where(g > 0, y1, np.exp(first) * own)
                log = np.where(g > 0, log, 0.0)
            total = y0 + y1
            v0[:, :m], v1[:, :m] = y0 / total, y1 / total
            scale[:, :m] += log + np.log(total)
            ahead.append((v0[0, :m].copy(), v1[0, :m].copy()))
        last = self.gaps[:, -1] - (self.sizes == 0)  # a document without features begins with a quiet token
        z0, z1, log = run(v0, v1, last)
        found = scale + log + np.log(z0 + z1)
        if not nodes:
            return found
        one = [float(x[0, 0]) for x in (up, u01, u10, u11)]
        (a, b, c, d), _ = self.power([np.array([x[0, 0]]) for x in quiet], self.gaps[:, -1])
        b0, b1, out = a + b, c + d, np.zeros((n, width))
        for k in range(width - 1, -1, -1):
            m = live[k]
            f0, f1 = ahead[k]
            out[:m, k] = f1 * b1[:m] / (f0 * b0[:m] + f1 * b1[:m])
            if k:
                own = np.exp(np.minimum(60.0, e[self.kinds[:m, k]] + par[0, 0]))
                w0, w1 = b0[:m] + one[1] * own * b1[:m], one[2] * b0[:m] + one[3] * own * b1[:m]
                (a, b, c, d), _ = self.power([np.array([x[0, 0]]) for x in quiet], self.gaps[:m, k])
                w0, w1 = a * w0 + b * w1, c * w0 + d * w1
                b0[:m], b1[:m] = w0 / (w0 + w1), w1 / (w0 + w1)
        return found, out

    def likelihood(self, logz):
        """The log likelihood of the labels, by row of parameters."""
        import numpy as np

        some = np.maximum(logz, 1e-12)
        return (np.where(self.toxic, np.log(-np.expm1(-some)), -some) * self.times).sum(axis=1)


def _train(held: list, chosen: set[str], sets: list[tuple], rounds: int) -> Model:
    """Gradient ascent on the likelihood of the documents' labels; tags are latent. sets: the features of each kind."""
    import numpy as np

    names = sorted(chosen)
    place = {f: i for i, f in enumerate(names)}
    bearing = np.zeros((len(sets), len(names)))
    for i, fs in enumerate(sets):
        bearing[i, [place[f] for f in fs]] = 1
    # NONE, as an index, finds the last entry, which is NONE.
    chains = Chains(((_dense(x), y) for x, y in held), np.array([*range(len(sets)), NONE]))
    par, weights = np.array([-4.0, 0.0, 0.0, 0.0, 0.0]), np.ones(len(names))
    square, before, still, tiny = np.zeros(5 + len(names)), -np.inf, 0, 1e-4
    for _ in range(rounds if len(chains.toxic) else 0):
        e = bearing @ weights
        logz, nodes = chains.logz(np.concatenate([par[None], par + tiny * np.eye(5)]), e, nodes=True)
        own, z = chains.likelihood(logz), np.maximum(logz[0], 1e-12)
        factor = np.where(chains.toxic, 1 / np.expm1(np.minimum(z, 700)), -1.0) * chains.times
        felt = np.bincount(chains.kinds[chains.kinds >= 0], weights=(factor[:, None] * nodes)[chains.kinds >= 0], minlength=len(sets))
        grad = np.concatenate([(own[1:] - own[0]) / tiny - RIDGE * par, felt @ bearing - RIDGE * weights])
        square += grad * grad
        move = 0.5 * grad / np.sqrt(square + 1e-9)
        par, weights = par + move[:5], weights + move[5:]
        still = still + 1 if abs(own[0] - before) < 1e-4 * abs(own[0]) else 0
        before = own[0]
        if still == 3:
            break
    bias, first, s01, s10, s11 = map(float, par)
    model = Model(dict(zip(names, map(float, weights), strict=True)), bias, first, ((0.0, s01), (s10, s11)), fitted=True)
    of = np.array([*(sum(model.weights[f] for f in fs) for fs in sets), 0.0])
    xs = []
    for x, y in held:
        es = of[_dense(x)].tolist() if len(x[1]) else []
        xs.append((*(_summary(model.marginals(es)) if any(es) else model.quiet(x[0])), y))
    model.curve = _logistic(xs)
    return model


def _expected(model: Model, evidence: list[float]) -> tuple[list[float], list[list[float]]]:
    """Node marginals, and expected counts of steps between states, token by token: the plain form of Chains."""
    (a, b), (c, d) = [[math.exp(x) for x in row] for row in model.step]
    own = [math.exp(min(60.0, e + model.bias)) for e in evidence]
    ratio, ahead = 0.0, []
    for i, o in enumerate(own):
        ratio = o * (math.exp(model.first) if not i else (b + d * ratio) / (a + c * ratio))
        ahead.append(ratio)
    back, backs = 1.0, [1.0] * len(own)
    for i in range(len(own) - 1, 0, -1):
        o = own[i] * back
        back = (c + d * o) / (a + b * o)
        backs[i - 1] = back
    pair = [[0.0, 0.0], [0.0, 0.0]]
    for i in range(len(own) - 1):
        o = own[i + 1] * backs[i + 1]
        ways = (a, b * o, ahead[i] * c, ahead[i] * d * o)
        z = sum(ways)
        for k, w in enumerate(ways):
            pair[k // 2][k % 2] += w / z
    return [r * k / (1 + r * k) for r, k in zip(ahead, backs, strict=True)], pair


def _logistic(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Newton steps for label ~ 1 / (1 + exp(-(a + b x + c y))), with a small ridge."""
    import numpy as np

    x = np.array([(1.0, p, q) for p, q, _ in rows])
    y = np.array([r[2] for r in rows], float)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        move = np.linalg.solve(hess, x.T @ (y - p) - 0.1 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from the labelled rows that aren't held out, at most (1 + CLEAN_TIMES) * sample of them."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))
    order = [F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id")]
    # Some labels are of documents that aren't here; so twice as many ids are drawn, and the first of those found stay.
    drawn = known.filter("toxic = 1").orderBy(*order).limit(2 * sample).unionByName(known.filter("toxic = 0").orderBy(*order).limit(2 * CLEAN_TIMES * sample))
    ids = docs.select("doc_id").join(F.broadcast(drawn), "doc_id", "left_semi").distinct()
    here = drawn.join(F.broadcast(ids), "doc_id", "left_semi")
    here = here.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(here.filter("toxic = 0").orderBy(*order).limit(CLEAN_TIMES * sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(here), "doc_id").filter("text IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = stored(rows, "toxic-sample")
    texts = lambda y: lambda: _within(r.text for r in rows.filter(F.col("toxic") == y).orderBy(*order).select("text").toLocalIterator())
    model = _fit(texts(1), texts(0))
    free()
    return model


def _within(texts: Iterable[str]) -> Iterator[str]:
    """As many of the texts, in order, as have SAMPLE_CHARS characters."""
    n = 0
    for t in texts:
        n += len(t)
        if n <= SAMPLE_CHARS:
            yield t


RESULT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))),
    ]
)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs packed as `row`, with tox: the score and the offending spans."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return _apply(rows, "row.text", model)


def _apply(rows: DataFrame, text: str, model: Model) -> DataFrame:
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def tag(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for texts in parts:
            done = [scorer(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in done], "spans": [x for _, x in done]})
        free()

    return rows.withColumn("tox", tag(F.col(text)))


class Scorer:
    """Scores texts. One pass of an automaton over the lower-cased text tells whether any evidence can be in it."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model, self.words, self.quiet = model, {}, {}
        self.any = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for f in model.weights:
            self.any.add_word(f.removeprefix("^"))
        if model.weights:
            self.any.make_automaton()

    def __call__(self, text: str | None) -> tuple[float, list]:
        low = (text or "").lower()
        if not self.model.weights or next(self.any.iter(low), None) is None:
            return self._quiet(low), []
        words, known = low.split(), self.words
        if len(known) > REMEMBERED:
            known.clear()
        evidence = [known[w] if w in known else known.setdefault(w, self.model.evidence(w)) for w in words]
        if not any(evidence):
            return self._quiet(low), []
        marginals = self.model.marginals(evidence)
        own = [i for i, e in enumerate(evidence) if e > 0]
        score, where = self.model.score(_summary(marginals)), [i for i in own if marginals[i] >= 0.5]
        if own and not where and score >= AT_LEAST:
            where = [max(own, key=marginals.__getitem__)]
        return score, _spans(text, where, marginals) if where else []

    def _quiet(self, low: str) -> float:
        """Without evidence the marginals depend on the number of words alone."""
        n = len(low.split())
        if n not in self.quiet:
            if len(self.quiet) > REMEMBERED:
                self.quiet.clear()
            self.quiet[n] = self.model.score(self.model.quiet(n))
        return self.quiet[n]


def _spans(text: str, where: list[int], marginals: list[float]) -> list:
    import re

    wanted, out = set(where), []
    # Lower-casing keeps white space where it is, so the words match by number.
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i in wanted:
            lead = len(m[0]) - len(m[0].lstrip(PUNCTUATION))
            out.append({"start": m.start() + lead, "end": m.start() + len(m[0].rstrip(PUNCTUATION)), "marginal": marginals[i]})
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = _apply(docs, "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox.score").alias("score"), (F.col("tox.score") >= AT_LEAST).cast("int").alias("predicted"), F.size("tox.spans").alias("n_spans"))


def cleaned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects."""
    return scored(docs, train(docs, labels)).filter(F.col("tox.score") < AT_LEAST).select("row.*")
