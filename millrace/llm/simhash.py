"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, Hamming checks, connected components.

Fingerprints that differ in at most 4 of 64 bits agree on all but 4 of any split into blocks. Each distinct
fingerprint is dealt under every choice of `blocks - 4` blocks; whoever is close shares one of those keys. Within a key
a breadth-first walk over the fingerprints not reached so far checks Hamming distances and gives one link for each
fingerprint it reaches, not one for each pair. Keys that hold more than GROUP fingerprints are cut into slices and
every pair of slices is walked as a task of its own, so that no task holds more than two slices. Components come from
alternating large-star and small-star steps on the links.

Defined cases: null and empty texts, and those of white space, have fingerprint zero, linked like any other. A null
doc_id takes part but is never the smallest unless the component has no other. Repeated rows are rows. An empty table
gives an empty table. Other columns pass through `near_deduped` whatever their names.

`near_deduped` is a stage, not the query: it joins texts by the exact Jaccard similarity of five-word shingles, 0.8 or
more. The blocks and walks over SimHashes of those shingles give the first candidates; as pairs at 0.8 may differ in 14 bits
and more, beyond any bound that blocks can search, a prefix filter finds the others (jaccard.py).
"""

from __future__ import annotations

from itertools import accumulate, combinations
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import jaccard
from .common import BROADCAST_ROWS, ship, stored

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Most fingerprints of a key in one slice.
GROUP = 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of the lower-cased words' shingles, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    whole, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    starts, stops = ends[:n], ends[min(shingle, len(words)) :]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = [xxh64_intdigest(whole[a : b - 1], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=False)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp for each row of docs (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(fps, pa.int64())], names=["doc_id", "th", "fp"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def block_keys(fp: Column, blocks: int, distance: int = DISTANCE) -> list[Column]:
    """A key (choice, bits) for each choice of blocks - distance blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(c)) for c in combinations(masks, blocks - distance)]
    return [F.struct(F.lit(i).cast("short").alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(chosen)]


def n_blocks(n: int) -> int:
    """Blocks for n fingerprints: so many that unlike fingerprints share few keys by chance."""
    return next((b for b in range(DISTANCE + 2, 16) if 64 * (b - DISTANCE) // b >= n.bit_length() + 1), 16)


def _walk(fps, distance: int) -> list[tuple[int, int]]:
    """Close pairs that span the parts of the distinct fingerprints fps (uint64) joined by close pairs."""
    import numpy as np

    rest, links = np.sort(fps), []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            by = np.full(len(rest), -1)
            for at in range(0, len(front), 256):
                left = np.flatnonzero(by < 0)
                near = np.bitwise_count(rest[left][None, :] ^ front[at : at + 256, None]) <= distance
                by[left] = np.where(near.any(axis=0), at + near.argmax(axis=0), -1)
            links += zip(front[by[by >= 0]], rest[by >= 0], strict=True)
            front, rest = rest[by >= 0], rest[by < 0]
    return links


def _links(batches: Iterator) -> Iterator:
    """From rows sorted by task (choice, bits, i, j) to links within each."""
    import numpy as np
    import pyarrow as pa

    def out(pairs: list) -> object:
        both = np.array(pairs, "u8").reshape(-1, 2).view("i8")
        return pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held: list = []  # the last, perhaps unfinished task of the batches before
    for batch in batches:
        cols = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) if held else batch.column(c).to_numpy(zero_copy_only=False) for c, h in zip(("choice", "bits", "i", "j", "fp"), held or [None] * 5, strict=True)]
        n = len(cols[4])
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)
        at = np.flatnonzero(new)
        last = at[-1] if len(at) else 0
        held = [c[last:].copy() for c in cols]
        sizes = np.diff(at)
        fps = cols[4].view("u8")
        two = at[:-1][sizes == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= DISTANCE
        pairs = np.stack([fps[two][near], fps[two + 1][near]], axis=1).tolist()
        for a, size in zip(at[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            pairs += _walk(fps[a : a + size], DISTANCE)
        yield out(pairs)
    if held and len(held[4]) > 1:
        yield out(_walk(held[4].view("u8"), DISTANCE))


def links(fps: DataFrame, n: int, group: int = GROUP) -> DataFrame:
    """a, b: links that join all of the n distinct fingerprints fp that are close, directly or in steps."""
    ship(fps.sparkSession)
    keys = fps.select("fp", F.explode(F.array(*block_keys(F.col("fp"), n_blocks(n)))).alias("key"))
    # A key without company can't give a link; a large one is cut.
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    large = stored(sizes.filter(F.col("n") > group).select(F.col("key").alias("k"), F.ceil(F.col("n") / group).cast("int").alias("slices")), "sim-large")
    n_large = large.count()
    if n_large:
        keys = keys.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, F.col("key") == F.col("k"), "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        own = F.pmod(F.xxhash64("fp", "key"), F.col("slices")).cast("int")
        keys = keys.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        keys = keys.select("fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        keys = keys.select("fp", "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    tasks = keys.select(F.col("key.choice").alias("choice"), F.col("key.bits").alias("bits"), "i", "j", "fp")
    found = tasks.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j").mapInArrow(_links, "a long, b long")
    return found.distinct()


def _minima(rows: DataFrame, low: DataFrame, often: int) -> DataFrame:
    """u, v, m of rows (u, v) and low (u, m, n: rows of u). Those with over `often` rows are few, for n adds up to the
    rows: they go by broadcast, so that no node's rows meet in one task; the others by shuffle."""
    hot = F.broadcast(low.filter(F.col("n") > often).select(F.col("u").alias("h"), F.col("m").alias("hm")))
    marked = rows.join(hot, F.col("u") == F.col("h"), "left")
    few = marked.filter("h IS NOT NULL").select("u", "v", F.col("hm").alias("m"))
    return few.unionByName(marked.filter("h IS NULL").select("u", "v").join(low.filter(F.col("n") <= often).select("u", "m"), "u"))


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of pairs (a, b) that isn't a root itself."""

    def kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "cc", narrow=True)
        return out, (seen.get["n"], seen.get["x"])

    edges, state = kept(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while state[0]:
        often = max(200, state[0] // 20_000)  # at most 20,000 nodes have more rows, of two longs each
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = stored(_minima(both.filter("v > u"), low, often).select(F.col("v").alias("u"), F.col("m").alias("v")), "cc", narrow=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _minima(large, low, often).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        before, (edges, state) = state, kept(small.distinct())
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(found: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """found (doc_id, fp, ...) with component_id, the smallest doc_id of those reachable by pairs (a, b) of fp; without
    pairs, by close fingerprints."""
    per = stored(found.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")), "sim-distinct", narrow=True)
    n, total = per.agg(F.count(F.lit(1)), F.sum("rows")).first()
    roots = components(links(per.select("fp"), n) if pairs is None else pairs)
    named = per.join(roots, per["fp"] == roots["node"], "left").select("fp", "rows", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # Fingerprints of large groups of copies are few (less than 50,000): they go by broadcast, the others by shuffle.
    often = max(2_000, (total or 0) // 50_000)
    classes = stored(named.join(lows, "root").select(F.col("fp").alias("f"), "component_id", (F.col("rows") > often).alias("hot")), "sim-classes", narrow=True)
    hot = F.broadcast(classes.filter("hot").select("f", F.col("component_id").alias("c"), "hot"))
    marked = found.join(hot, F.col("fp") == F.col("f"), "left").drop("f")
    few = marked.filter("hot").withColumnRenamed("c", "component_id").drop("hot")
    rest = marked.filter("hot IS NULL").drop("c", "hot").join(classes.filter("NOT hot").select("f", "component_id"), F.col("fp") == F.col("f")).drop("f")
    return few.unionByName(rest)


def close(sims: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints (one column) at most DISTANCE bits apart, enough to join all such pairs."""
    return links(sims.select(F.col(sims.columns[0]).alias("fp")), sims.count())


def near_deduped(docs: DataFrame, shingle: int = jaccard.SHINGLE, least: int = jaccard.LEAST) -> DataFrame:
    """docs without all but the first row (by doc_id, then hash of the text) of each component of texts whose shingles
    have a Jaccard similarity of least percent or more."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    texts = docs.select("doc_id", "text")
    found = stored(jaccard.shingled(texts, shingle, least), "sim-sets")
    pairs = jaccard.links(found, texts, components, shingle, least, close=close)
    out = stored(grouped(found.select("doc_id", "th", "fp"), pairs), "sim-groups", narrow=True).withColumn("key", F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc"), F.col("th").alias("th")))
    component = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = out.groupBy(component.alias("component")).agg(F.min("key").alias("key"))
    gone = stored(out.select("key").distinct().join(kept.select("key"), "key", "left_anti"), "sim-gone")
    few = gone.count() <= BROADCAST_ROWS
    own = F.struct(F.col("row.doc_id").isNull().alias("late"), F.col("row.doc_id").alias("doc"), F.xxhash64("row.text").alias("th"))
    rows = rows.withColumn("key", own)
    left = rows.join(F.broadcast(gone) if few else gone, "key", "left_anti")
    twice = stored(out.join(kept.select("key"), "key").groupBy("key").count().filter("count > 1").select("key"), "sim-twice")
    n = twice.count()
    if n:  # rows that repeat both doc_id and text: one stays
        twice = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
        left = left.join(twice, "key", "left_anti").unionByName(left.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    return left.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = stored(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "sim-fp", narrow=True)
    return grouped(found).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
