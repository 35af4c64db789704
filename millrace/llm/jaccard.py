"""Near copies by the Jaccard similarity of word shingles, exact: what SimHash blocks bring together and what a prefix
filter leaves is checked on the shingles themselves.

Pairs of fingerprints that share blocks (simhash.py) are checked first; they join most copies, and what they have joined
isn't looked at again. Fingerprints of sets of similarity 0.8 may differ in 14 bits and more, beyond any bound that blocks
can search, so the rest is found by prefixes. Two sets of n shingles whose similarity is t or more share SHARED of the
first n - ceil(t n) + SHARED shingles of each in any common order. The order puts shingles that are often in a sample of
the documents last, so a common passage gives few candidates; it decides on the work only, never on the result. Sets are
equal by a 64-bit hash. Shingles with up to PAIRS sets give every pair that sizes and positions allow and that isn't joined yet; those given by SHARED of them are checked.
A larger group gives pairs with one set of it, and then, in slices that are tasks of their own, each pair that these links
haven't joined, so a pair that shares such a shingle need not be counted. There ODD bits of each set rule out most of those
that aren't similar before they are written down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free, ship, stored

#: Words of a shingle; least similarity in percent.
SHINGLE, LEAST = 5, 80
SEED = 42
#: Most sets that share a shingle and are all paired at once; most of a slice of those beyond.
PAIRS, SLICE = 64, 4096
#: Bits in which two sets can't differ more often than in shingles.
ODD = 1024
#: Shingles of the prefixes that two sets must share; sets that differ and are 80 percent similar share four at least.
SHARED = 3
#: About the documents in the sample for the order, and the most shingles that it puts last.
SAMPLE, OFTEN = 10_000, 50_000
#: Rows that are paired together.
ROWS = 100_000


def shingles(text: bytes | None, shingle: int = SHINGLE) -> list[bytes]:
    """The shingles of the lower-cased words, repeats included; all words of a shorter text are one."""
    words = (text or b"").lower().split()
    if not words:
        return []
    whole, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    return [whole[a : b - 1] for a, b in zip(ends[:n], ends[min(shingle, len(words)) :], strict=False)]


def _hashes(text: bytes | None, shingle: int):
    """The hashes of the shingles, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, SEED) for s in shingles(text, shingle)], "u8")


def simhash(hashes) -> int:
    """The signed 64-bit SimHash of a text's hashes: bits that over half of them have."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def similar(a: frozenset, b: frozenset, least: int = LEAST) -> bool:
    both = len(a & b)
    return 100 * both >= least * (len(a) + len(b) - both)


def _often(docs: DataFrame, shingle: int) -> list:
    """(shingle hash, documents) for the shingles most often in a sample of the texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [np.unique(_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, "u8"), *found]).view("i8"))], names=["h"])

    texts = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    some = texts.filter(F.pmod("th", F.lit(max(1, docs.count() // SAMPLE))) == 0).dropDuplicates(["th"])
    counts = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter("count > 2")
    return [tuple(r) for r in counts.orderBy(F.desc("count"), "h").limit(OFTEN).collect()]


def shingled(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, th (hash of the text), fp (hash of the set of shingles), n (its size), keys (its prefix), sim (the
    SimHash of the shingles, repeats included) and odd (ODD bits: whether an odd number of its shingles falls there) for
    each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(sorted((h & (2**64 - 1), n) for h, n in _often(docs, shingle)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        often = np.array([h for h, _ in sent.value] + [2**64 - 1], "u8")
        times = np.array([n for _, n in sent.value] + [0], "i8")
        for batch in batches:
            fps, sizes, keys, sims, odds = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                hs = _hashes(t, shingle)
                sims.append(simhash(hs))
                hs = np.unique(hs)
                odds.append(np.packbits(np.bincount((hs % ODD).astype(int), minlength=ODD) & 1).tobytes())
                at = np.searchsorted(often, hs)
                late = np.where(often[at] == hs, times[at], 0)
                first = len(hs) - -(-least * len(hs) // 100) + SHARED
                fps.append(xxh64_intdigest(hs.tobytes(), SEED))
                sizes.append(len(hs))
                keys.append(hs[np.lexsort((hs, late))[:first]].view("i8"))
            fps = pa.array(np.array(fps, "u8").view("i8"))
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), fps, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sims, pa.int64()), pa.array(odds, pa.binary())], names=["doc_id", "th", "fp", "n", "keys", "sim", "odd"])
        free()

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long, n int, keys array<long>, sim long, odd binary")


def _whole(batches: Iterator, names: tuple) -> Iterator:
    """The columns names of rows sorted by key, about ROWS at a time, each key's rows together."""
    import numpy as np

    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += batch.num_rows
        if n < ROWS:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = int(np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))[-1])
        if last:
            yield [c[:last] for c in cols]
        held = [[c[last:].copy() for c in cols]]
        n = len(cols[0]) - last if last else 0  # of one key: as many again before the next look
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _starts(key):
    """For each row the row where its key starts, and its key's rows."""
    import numpy as np

    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.append(new, len(key)))
    return np.repeat(new, sizes), np.repeat(sizes, sizes)


def _possible(n, pos, i, j, least: int):
    """Whether sets i and j, with this shared shingle at these positions, can be so similar."""
    import numpy as np

    n, pos = n.astype(np.int64), pos.astype(np.int64)
    a, b, p, q = n[i], n[j], pos[i], pos[j]
    most = np.minimum(p, q) + np.minimum(a - p, b - q)
    return (100 * np.minimum(a, b) >= least * np.maximum(a, b)) & ((100 + least) * most >= least * (a + b))


def _paired(key, fp, n, pos, least: int, label, task=None, odd=None) -> Iterator:
    """Every possible pair of rows that share a key (and a task) and differ in label; odd: the bits, in rows of words."""
    import numpy as np

    for d in range(1, len(key)):
        i = np.flatnonzero((key[d:] == key[:-d]) & (True if task is None else task[d:] == task[:-d]))
        if not len(i):
            return
        i = i[label[i] != label[i + d]]
        i = i[_possible(n, pos, i, i + d, least)]
        if odd is not None:  # similar sets have at most (100 - least) / (100 + least) of their sizes' sum in one of them alone
            apart = np.bitwise_count(odd[i] ^ odd[i + d]).sum(axis=1, dtype=np.int64)
            i = i[(100 + least) * apart <= (100 - least) * (n[i].astype(np.int64) + n[i + d])]
        yield fp[i], fp[i + d]


def _likely(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """pairs without those that their prefixes rule out: of the shingles that two sets share, all that stand in both
    prefixes are known, and the others stand behind the prefix that ends first."""
    side = lambda a, n, k: sets.select(F.col("fp").alias(a), F.col("n").cast("long").alias(n), F.col("keys").alias(k))
    both = pairs.join(side("a", "n", "k"), "a").join(side("b", "m", "l"), "b")
    most = F.size(F.array_intersect("k", "l")) + F.greatest(F.col("n") - F.size("k"), F.col("m") - F.size("l"))
    return both.filter((100 + least) * most >= least * (F.col("n") + F.col("m"))).select("a", "b")


def _of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of sets that stand in pairs."""
    fps = stored(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "near-of")
    return sets.join(F.broadcast(fps) if fps.count() <= BROADCAST_ROWS else fps, "fp", "left_semi")


def _checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, least: int, times: int = 1) -> DataFrame:
    """Those of pairs (a, b) that stand there so many times and are similar. sets: fp, n, keys and th of a text of each set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = lru_cache(maxsize=16)(lambda t: frozenset(shingles(t, shingle)))
        for batch in batches:
            ok = [similar(own(x.as_py()), frozenset(shingles(y.as_py(), shingle)), least) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        own.cache_clear()
        free()

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").count().filter(F.col("count") >= times).select("a", "b")
    pairs = stored(pairs, "near-counted")
    wanted = stored(_of(sets, pairs), "near-wanted")
    pairs = stored(_likely(pairs, wanted, least), "near-pairs")
    wanted = stored(_of(wanted.select("fp", "th"), pairs), "near-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    texts = stored(texts.join(F.broadcast(wanted) if few else wanted, "th").dropDuplicates(["fp"]).select("fp", "text"), "near-texts")
    rows = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a")
    return stored(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "near-links")


def links(found: DataFrame, docs: DataFrame, components, shingle: int = SHINGLE, least: int = LEAST, most: int = PAIRS, close=None) -> DataFrame:
    """a, b: links that join all sets of found (see shingled) that are similar, directly or in steps.

    components(pairs): node and root of those joined; close(sims): pairs of the distinct fingerprints sim that are close."""
    sets = stored(found.select("fp", "th", "n", "keys", "sim", "odd").dropDuplicates(["fp"]), "near-sets")
    linked = None
    if close is not None:
        heads = stored(sets.groupBy("sim").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")), "near-sims")
        head = lambda of, name: heads.select(F.col("sim").alias(of), F.col("head").alias(name))
        far = close(heads.select("sim")).join(head("a", "x"), "a").join(head("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        same = sets.join(heads.filter("n > 1").select("sim", "head"), "sim").filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
        linked = _checked(far.unionByName(same), sets, docs, shingle, least)

    def labelled(rows: DataFrame) -> DataFrame:
        if linked is None:
            return rows.withColumn("label", F.col("fp"))
        return rows.join(components(linked), F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("root", "fp")).drop("node", "root")

    def first(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        out = lambda *cols: pa.record_batch([pa.array(c, t) if c is not None else pa.nulls(len(cols[0]), t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "key", "n", "pos"])
        for key, fp, n, pos, label in _whole(batches, ("key", "fp", "n", "pos", "label")):
            start, size = _starts(key)
            some = np.flatnonzero((size > 1) & (size <= most))
            for a, b in _paired(key[some], fp[some], n[some], pos[some], least, label[some]):
                yield out(a, b, None, None, None)
            large = np.flatnonzero(size > most)
            if len(large):
                i = large[label[large] != label[start[large]]]
                i = i[_possible(n, pos, start[i], i, least)]
                yield out(fp[start[i]], fp[i], np.zeros(len(i), "i8"), None, None)
                yield out(fp[large], None, key[large], n[large], pos[large])
        free()

    keys = labelled(sets.select("fp", "n", "keys")).select("fp", "n", "label", F.posexplode("keys").alias("pos", "key"))
    got = stored(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(first, "a long, b long, key long, n int, pos int"), "near-first")
    # Pairs with the first set of a large group need no counting; they have a key, of 0.
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("key").isNull(), 1).otherwise(SHARED)))
    found = _checked(got.filter("b IS NOT NULL").select("a", "b", times).select("a", "b"), sets, docs, shingle, least, SHARED)
    linked = found if linked is None else linked.unionByName(found)
    large = got.filter("b IS NULL").select("key", F.col("a").alias("fp"), "n", "pos")
    if large.isEmpty():
        return linked

    def rest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for task, key, fp, n, pos, label, odd in _whole(batches, ("task", "key", "fp", "n", "pos", "label", "odd")):
            bits = np.frombuffer(b"".join(odd.tolist()), np.uint64).reshape(-1, ODD // 64)
            for a, b in _paired(key, fp, n, pos, least, label, task, bits):
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
        free()

    # Only keys whose sets are still apart have anything left to pair.
    rows = stored(labelled(large).join(sets.select("fp", "odd"), "fp"), "near-rest")
    open_ = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    rows = rows.join(open_.select("key", F.ceil(F.col("size") / SLICE).cast("int").alias("slices")), "key")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("slices")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.withColumn("task", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select("task", "key", "fp", "n", "pos", "label", "odd")
    pairs = rows.repartition("task").sortWithinPartitions("task", "key", "fp").mapInArrow(rest, "a long, b long")
    return linked.unionByName(_checked(pairs, sets, docs, shingle, least))
