"""Token ids in files of directly addressable codes, JVM writers and readers, any store that Spark reaches.

An id is split into chunks of CHUNK bits, low ones first. Level 0 holds the first chunk of every id, level 1 the second
chunk of those ids that have one, and so on; a level's continuation bitmap says which of its ids go on, and its rank
directory holds the number of set bits before each 512-bit block. The j-th chunk of any id is found by one rank for each
level, so `Shard.get(i)` reads one id without decoding others.

Documents are dealt to ranges of doc_id, encoded in that order by the tokenizer library and written as shards of about
SHARD ids, a document whole in one shard. The file format is Parquet with a row for each shard: part and shard number,
number of documents and ids, the document offsets, and each level's chunks, bitmap and directory, neither compressed nor
in dictionaries. A page holds one shard and file names carry the part's number, so `token` reads one page of one file, by
the column index, and no other id is decoded. Spark's committer writes the files, so a lost executor or a
repeated task leaves no half-written ones. `start` of a document is counted from the totals of the ranges before it, a
row for each range.

Defined cases: null counts as the empty text, which has the end id alone. Rows that repeat a doc_id follow each other
by text. A null doc_id comes after all others; doc_id keeps its type. The empty table writes no shard. A very long text is
one long shard. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import zlib
from hashlib import sha256
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remembered, shared_path, ship, stored, written
from .pieces import Letters, Pieces, binary, gathered, runs, words

#: Bits of a chunk; ids of a shard; pieces in a generation of a worker's memory; bits of a directory block.
CHUNK, SHARD, REMEMBERED, BLOCK = 8, 1 << 15, 300_000, 512


def pack(ids) -> list[tuple[bytes, bytes, bytes]]:
    """Levels of ids (unsigned): chunks, continuation bitmap, rank directory."""
    import numpy as np

    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >= 1 << CHUNK
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        levels.append(((rest & ((1 << CHUNK) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4").tobytes()))
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK


class Shard:
    """Levels as written. get: one id; slice: ids a..b; neither decodes what it isn't asked for."""

    def __init__(self, levels: list) -> None:
        import numpy as np

        self.levels = [(np.frombuffer(c, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(d, "<u4")) for c, b, d in levels]

    @staticmethod
    def rank(bits, directory, i: int) -> int:
        """Set bits before place i."""
        if i // BLOCK >= len(directory):
            i, extra = len(directory) * BLOCK, 0
            return int(directory[-1]) + int.from_bytes(bits[i // 8 - BLOCK // 8 :].tobytes(), "little").bit_count() if len(directory) else extra
        head = i // BLOCK * (BLOCK // 8)
        return int(directory[i // BLOCK]) + (int.from_bytes(bits[head : i // 8 + 1].tobytes(), "little") & ((1 << i - 8 * head) - 1)).bit_count()

    def get(self, i: int) -> int:
        out = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out |= int(chunks[i]) << CHUNK * level
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(bits, directory, i)
        return out

    def slice(self, a: int, b: int):
        import numpy as np

        out, place = np.zeros(b - a, np.uint32), np.arange(b - a)
        for level, (chunks, bits, directory) in enumerate(self.levels):
            out[place] |= chunks[a:b].astype(np.uint32) << np.uint32(CHUNK * level)
            goes = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            place = place[goes]
            if not len(place):
                break
            a = self.rank(bits, directory, a)
            b = a + len(place)
        return out


#: The normaliser and the splitting pattern under which pieces between white space have their own ids (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parted(definition: dict) -> bool:
    """Whether a tokenizer drops white space, lowers case and parts letters from marks, so that pieces may be encoded apart."""
    normal, split = definition.get("normalizer") or {}, (definition.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = [{k: v for k, v in n.items() if k in ("type", "pattern", "content")} for n in normal.get("normalizers", [])]
    cut = split[0].get("type") == "Split" and split[0].get("pattern") == {"Regex": PATTERN} and split[0].get("behavior") == "Removed" and split[0].get("invert") is True
    marked = all(set(t["content"]) & set("<|>") and not t["content"].split()[1:] and not t["lstrip"] and not t["rstrip"] for t in definition.get("added_tokens", []))
    return plain == NORMALIZERS and cut and [p.get("use_regex") for p in split[1:]] == [False] and marked


class Encoder:
    """The library's ids of texts. Where the tokenizer's definition allows (see parted), pieces between ASCII white
    space are encoded apart and remembered, up to a bound; any other definition gets whole texts."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.apart = parted(json.loads(definition))
        self.pieces = Pieces(REMEMBERED, Letters(self._letter), self._words, self._alone, lower=True)

    def _letter(self, c: str) -> bool:
        """Whether the tokenizer keeps a character as one letter: it takes it for a part of the word about it."""
        normal = self.library.normalizer.normalize_str(f"x{c}x")
        return len(normal) == 3 and len(self.library.pre_tokenizer.pre_tokenize_str(normal)) == 1

    def _alone(self, texts: list[bytes]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<i4").tobytes() for e in self.library.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _words(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of words of letters: many in one call, parted by the number of the word that each id is of."""
        import numpy as np

        out: list[bytes] = []
        for at in range(0, len(bodies), 2000):
            run = bodies[at : at + 2000]
            found = self.library.encode(b" ".join(run).decode(), add_special_tokens=False)
            of = np.array(found.word_ids, np.int64)
            ends = np.searchsorted(of, np.arange(len(run) + 1)).tolist()
            if not len(of) or of[-1] != len(run) - 1 or 0 in np.diff(ends):
                out += self._alone(run)
                continue
            ids = np.array(found.ids, "<i4").tobytes()
            out += [ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def ids(self, texts):
        """The ids of all texts (large binary) in one array, and the bounds of each text in it."""
        import numpy as np

        if self.apart:
            return self.pieces.placed(*words(texts))
        made = self._alone(texts.to_pylist())
        return np.frombuffer(b"".join(made), "<i4"), np.cumsum([0, *(len(m) // 4 for m in made)])

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        import pyarrow as pa

        ids, ends = self.ids(binary(pa.array(texts, pa.binary())))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def read_definition(path: str) -> str:
    """The tokenizer file, without truncation and padding."""
    with open(path, encoding="utf-8") as f:  # on the driver; the text goes to the executors
        return json.dumps(json.load(f) | {"truncation": None, "padding": None})


#: A page of a file is one shard's, as it is: no compression, no dictionaries.
PAGES = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
FORMAT = "part int, shard int, n_docs long, n_ids long, doc_ids array<{kind}>, offsets binary, levels array<struct<chunks: binary, bitmap: binary, directory: binary>>"


def write(docs: DataFrame, definition: str, path: str, end_id: int = 2) -> None:
    """Writes the ids of docs (doc_id, text), each followed by end_id, to path, in ascending doc_id order."""
    spark = docs.sparkSession
    ship(spark)
    sent, digest = spark.sparkContext.broadcast(definition), sha256(definition.encode()).hexdigest()
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    ranged = ranged.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, part, shard = remembered(digest, Encoder, sent.value), TaskContext.get().partitionId(), 0
        kinds = pa.struct([(n, pa.binary()) for n in ("chunks", "bitmap", "directory")])
        for rows in gathered(batches, "text"):
            texts, at = binary(rows.column("text")), 0
            for texts in runs(texts):
                ids, ends = encoder.ids(texts)
                ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
                while len(ends) > 1:
                    n = min(len(ends) - 1, int(np.searchsorted(ends, ends[0] + SHARD)))
                    whole = ids[ends[0] : ends[n]]
                    levels = [dict(zip(("chunks", "bitmap", "directory"), x, strict=True)) for x in pack(whole)]
                    keys = rows.column("doc_id").slice(at, n)
                    lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys)
                    cols = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([len(whole)], pa.int64()), lists, pa.array([(ends[: n + 1] - ends[0]).astype("<i8").tobytes()], pa.binary()), pa.array([levels], pa.list_(kinds))]
                    yield pa.record_batch(cols, names=["part", "shard", "n_docs", "n_ids", "doc_ids", "offsets", "levels"])
                    ends, at, shard = ends[n:], at + n, shard + 1

    ranged.mapInArrow(run, FORMAT.format(kind=kind)).write.mode("overwrite").options(**PAGES).parquet(path)


def token(spark, path: str, part: int, shard: int, i: int) -> int:
    """The i-th id of a shard, from the page that the shard's row stands in."""
    rows = spark.read.parquet(f"{path}/part-{part:05d}-*").filter(F.col("shard") == shard).select("levels").collect()
    return Shard([(x.chunks, x.bitmap, x.directory) for x in rows[0].levels]).get(i)


def documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""
    ship(spark)
    shards = spark.read.parquet(path)
    per = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # A row for each part: their number is that of the write's tasks.
    parts = per.select(F.col("part").alias("p"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    within = shards.select(F.col("part").alias("p"), F.col("shard").alias("s"), "n_ids").withColumn("shard_start", F.sum("n_ids").over(Window.partitionBy("p").orderBy("s")) - F.col("n_ids"))
    starts = stored(within.join(parts, "p").select("p", "s", (F.col("part_start") + F.col("shard_start")).alias("start")), "token-starts")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ends = np.frombuffer(one["offsets"], "<i8")
                ids = memoryview(Shard([(x["chunks"], x["bitmap"], x["directory"]) for x in one["levels"]]).slice(0, int(ends[-1])).astype("<u4").tobytes())
                crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.record_batch([batch.column("doc_ids")[row].values, pa.array(one["start"] + ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = shards.join(starts, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select("start", "doc_ids", "offsets", "levels")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_definition(public_tokenizers.path("word_bpe_49k.json")), path)
    return documents(spark, written(spark, path))
