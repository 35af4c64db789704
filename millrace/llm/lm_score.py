"""Language-model scores by prediction by partial matching over bytes, trained on the corpus.

A text's tokens, joined by single blanks and closed by a line end, are read as bytes, each after ORDER bytes of context
(line ends before the first). Training counts every such (context, byte) of every training document; counts of shorter
contexts are sums of those of longer ones, so the tables of orders ORDER to 0 are the levels of a byte-context trie.
With n counts of d different bytes after a context, a byte counted k times has probability (2k - 1) / 2n, and
d / 2n is left for escaping to the context one byte shorter, from which the bytes already offered are excluded. Below
order 0 the bytes left are alike. A document's code length is the sum over its bytes.

Two tables of bounded size, the HEAD_GRAMS and HEAD_WORDS (of up to WORD_BYTES) with the highest counts, go to every
task by broadcast; they are a fast path only. Whatever isn't in them goes by shuffle to the full tables, as (row, gram or word, count), so
counts cover the whole corpus and no table has to fit into one task. Bytes never seen after their context go through
joins with the trie's levels, a node holding at most 256 bytes and counts.

Defined cases: null counts as the empty text, which has the end alone. Without training rows all bytes are alike and
base_score is 0. A null doc_id isn't held out. Repeated rows are rows of their own. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import some
from .common import ship, stored

ORDER = 5
HEAD_GRAMS, HEAD_WORDS = 400_000, 150_000
#: Bytes of the longest word that the head table may hold, so that its rows bound its size.
WORD_BYTES = 64
#: Grams or words that a task gathers before it hands them on.
GATHERED = 3_000_000
MIX = 0x9E3779B97F4A7C15


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[list[bytes]], order: int):
    """(context, byte) of all texts as integers, and where each text's begin."""
    import numpy as np

    pad = b"\n" * order
    parts = [pad + b" ".join(words) + b"\n" for words in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    last = np.cumsum(sizes)
    counts = sizes - order
    begins = np.cumsum(counts) - counts
    # Windows that begin in a text's last `order` bytes would run into the next text.
    at = np.arange(counts.sum()) + np.repeat(last - sizes - begins, counts)
    out = np.zeros(len(at), np.int64)
    for i in range(order + 1):
        out = out << 8 | raw[at + i]
    return out, begins


def _gathered(docs: DataFrame, order: int) -> DataFrame:
    """gram, word, n: counts over docs (text), summed within tasks. A row has a gram or a word."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words, held, n = Counter(), [], 0

        def merged(parts: list):
            keys = np.concatenate([k for k, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            order_ = np.argsort(keys, kind="stable")
            keys, counts = keys[order_], counts[order_]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            return keys[new], np.add.reduceat(counts, new) if len(new) else counts

        def out(keys, counts, ws):
            for at in range(0, len(keys), 1 << 17):
                k, c = keys[at : at + (1 << 17)], counts[at : at + (1 << 17)]
                yield pa.record_batch([pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(c)], names=["gram", "word", "n"])
            items = list(ws.items())
            for at in range(0, len(items), 1 << 17):
                w = items[at : at + (1 << 17)]
                yield pa.record_batch([pa.nulls(len(w), pa.int64()), pa.array([x for x, _ in w], pa.binary()), pa.array([c for _, c in w], pa.int64())], names=["gram", "word", "n"])

        for batch in batches:
            for texts in some(batch.column("text").to_pylist(), 4 << 20):
                cut = [tokens(t) for t in texts]
                for ws in cut:
                    words.update(ws)
                keys, counts = np.unique(grams(cut, order)[0], return_counts=True)
                held.append((keys, counts.astype(np.int64)))
                n += len(keys)
                if len(held) > 8 or n > GATHERED:
                    held = [merged(held)]
                    n = len(held[0][0])
                if n > GATHERED // 2 or len(words) > 300_000:
                    yield from out(*merged(held), words)
                    words, held, n = Counter(), [], 0
        if held:
            yield from out(*merged(held), words)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "gram long, word binary, n long")


class Table:
    """A fixed map from 64-bit keys to numbers, by open addressing; missing keys give nan."""

    def __init__(self, keys, values) -> None:
        import numpy as np

        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, np.nan)
        left = np.arange(len(keys))
        at = self._place(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several for one place the last stays
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _place(self, keys):
        import numpy as np

        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(MIX)) >> self.shift).astype(np.int64)

    def __call__(self, keys):
        import numpy as np

        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.nan)
        left = np.flatnonzero((found != keys) & (found != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            left, at = left[on], at[on]
        return out


class Head:
    """The broadcast tables: log10 probabilities of grams, and log10(c + 1) of words."""

    def __init__(self, gram_keys, gram_values, words: dict) -> None:
        self.gram_keys, self.gram_values, self.words, self.table = gram_keys, gram_values, words, None

    def grams(self, keys):
        if self.table is None:
            self.table = Table(self.gram_keys, self.gram_values)
        return self.table(keys)

    def __getstate__(self):
        return self.__dict__ | {"table": None}


ROWS = "uid long, doc_id {kind}, n_words long, n_known long, base double, score double, gram long, word binary, n long"


def _scored(docs: DataFrame, head: Head, order: int) -> DataFrame:
    """A row for each document with what the head tables know, and rows (uid, gram or word, n) for what they don't."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        uid, tables = TaskContext.get().partitionId() << 36, sent.value
        get = tables.words.get
        names = [x.split()[0] for x in ROWS.split(", ")]

        def rows(many, /, **cols):
            kinds = {"doc_id": id_type, "base": pa.float64(), "score": pa.float64(), "word": pa.binary()}
            return pa.record_batch([pa.array(cols[c], kinds.get(c, pa.int64())) if c in cols else pa.nulls(many, kinds.get(c, pa.int64())) for c in names], names=names)

        for batch in batches:
            ids, at, id_type = batch.column("doc_id").to_pylist(), 0, batch.schema.field("doc_id").type
            for texts in some(batch.column("text").to_pylist(), 2 << 20):
                cut = [tokens(t) for t in texts]
                keys, begins = grams(cut, order)
                logs = tables.grams(keys)
                lost = np.isnan(logs)
                logs[lost] = 0
                score = np.add.reduceat(logs, begins)
                base, known, rare_words, rare_counts, rare_uid = [], [], [], [], []
                for i, ws in enumerate(cut):
                    found = [get(w) for w in ws]
                    if None in found:
                        rare = Counter([w for w, v in zip(ws, found, strict=True) if v is None])
                        rare_words += rare.keys()
                        rare_counts += rare.values()
                        rare_uid += [uid + i] * len(rare)
                        found = [v for v in found if v is not None]
                    base.append(math.fsum(found))
                    known.append(len(found))
                n = len(cut)
                yield rows(n, uid=np.arange(n) + uid, doc_id=ids[at : at + n], n_words=[len(ws) for ws in cut], n_known=known, base=base, score=score)
                if lost.any():
                    where = np.flatnonzero(lost)
                    pairs, counts = np.unique(np.stack([np.searchsorted(begins, where, side="right") - 1, keys[where]], axis=1), axis=0, return_counts=True)
                    yield rows(len(pairs), uid=pairs[:, 0] + uid, gram=pairs[:, 1].copy(), n=counts)
                if rare_words:
                    yield rows(len(rare_words), uid=rare_uid, word=rare_words, n=rare_counts)
                uid, at = uid + n, at + n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, ROWS.format(kind=kind))


def levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """The trie: for each order from `order` to 0 a table ctx, bytes, counts, with a row for each context."""
    out, now = [], counts.select("gram", "n")
    for k in range(order, -1, -1):
        if k < order:
            now = stored(now.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n")), "ppm-level")
        node = F.sort_array(F.collect_list(F.struct(F.col("gram").bitwiseAND(F.lit(255)).alias("b"), "n")))
        out.append(now.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(node.alias("node")).select("ctx", F.col("node.b").alias("bytes"), F.col("node.n").alias("counts")))
    return out


def escaped(nodes: list, byte: int) -> float:
    """log10 of the probability of byte after a context, from its nodes (bytes, counts), the longest context first."""
    log, out = 0.0, set()
    for node in nodes:
        if node is None:
            continue
        left = {b: n for b, n in zip(*node, strict=True) if b not in out}
        if not left:
            continue
        total = 2 * sum(left.values())
        if byte in left:
            return log + math.log10((2 * left[byte] - 1) / total)
        log += math.log10(len(left) / total)
        out |= left.keys()
    return log - math.log10(256 - len(out))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (n, ...) with the largest n, at most `most` of them: all from that n on at which a histogram
    by steps of a hundredth of a doubling still holds no more. Nothing is sorted, and no task sends more than it has."""
    step = F.floor(F.log2("n") * 100).cast("int")
    histogram = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)  # at most 6,300 rows
    least, held = 1 << 20, 0
    for row in histogram:
        held += row["rows"]
        if held > most:
            break
        least = row["step"]
    return counts.filter(step >= least)


def _unseen(keys: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """gram, log for grams that were never counted."""
    now = keys.select("gram")
    for i, level in enumerate(levels(counts, order)):
        k = order - i
        on = F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)), 8)
        level = level.select(F.col("ctx").alias(f"c{i}"), F.struct("bytes", "counts").alias(f"n{i}"))
        now = now.join(F.broadcast(level) if k <= 1 else level, on == F.col(f"c{i}"), "left").drop(f"c{i}")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                nodes = [n and (n["bytes"], n["counts"]) for n in (row[f"n{i}"] for i in range(order + 1))]
                out.append(escaped(nodes, row["gram"] & 255))
            yield pa.record_batch([batch.column("gram"), pa.array(out, pa.float64())], names=["gram", "log"])

    return now.mapInArrow(run, "gram long, log double")


def scores(docs: DataFrame, order: int = ORDER, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    import numpy as np

    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    training = docs.filter(~held_out(F.col("doc_id")))
    gathered = stored(_gathered(training, order).groupBy("gram", "word").agg(F.sum("n").alias("n")), "ppm-counts")
    counts, words = gathered.filter("gram IS NOT NULL").select("gram", "n"), gathered.filter("word IS NOT NULL").select("word", "n")
    n_docs = training.count()
    n_words, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = n_words + n_docs, types + bool(n_docs)
    context = counts.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("all"))
    logs = counts.withColumn("ctx", F.shiftright("gram", 8)).join(context, "ctx").select("gram", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("all"))).alias("log"))
    logs = stored(logs, "ppm-logs")
    top = most_frequent(logs, head_grams).select("gram", "log").toArrow()
    often = most_frequent(words.filter(F.octet_length("word") <= WORD_BYTES), head_words).select("word", "n").toArrow()
    n_often = np.log10(often["n"].to_numpy() + 1.0).tolist()
    head = Head(top["gram"].to_numpy(), top["log"].to_numpy(), dict(zip(often["word"].to_pylist(), n_often, strict=True)))
    del top, often, n_often
    rows = stored(_scored(docs, head, order), "ppm-rows")
    # What the head tables don't hold: distinct grams and words, then the rows that ask for them.
    rare_grams = rows.filter("gram IS NOT NULL").select("uid", "gram", "n")
    missing = rare_grams.select("gram").distinct().join(counts.select("gram"), "gram", "left_anti")
    unseen = stored(_unseen(missing, counts, order), "ppm-unseen")
    gram_logs = logs.select("gram", "log").unionByName(unseen)
    by_gram = rare_grams.join(gram_logs, "gram").select("uid", (F.col("n") * F.col("log")).alias("score"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"))
    rare_words = rows.filter("word IS NOT NULL").select("uid", "word", "n")
    known = words.select("word", F.log10(F.col("n") + 1).alias("log"))
    by_word = rare_words.join(known, "word").select("uid", F.lit(0.0).alias("score"), (F.col("n") * F.col("log")).alias("base"), F.col("n").alias("known"))
    rest = by_gram.unionByName(by_word).groupBy("uid").agg(*[F.sum(c).alias(f"r_{c}") for c in ("score", "base", "known")])
    main = rows.filter("n_words IS NOT NULL").select("uid", "doc_id", "n_words", "n_known", "base", "score").join(rest, "uid", "left")
    n_tokens, end = F.col("n_words") + 1, math.log10(n_docs + 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return main.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + zero("r_known") + int(bool(n_docs))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("r_base") + end - n_tokens * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("score") + zero("r_score")).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
