"""Byte-level BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree hold (rank, position) of the pair that begins at each symbol; the root is the least, which
is the leftmost pair of the lowest rank. A merge changes three leaves, each updated along its path to the root, until
the root says that no pair can merge. `merge_word` does so for one word; `merge_words` keeps the trees of many short
words side by side in arrays and takes one merge of each at a time.

Text is cut where white space begins, as the splitting pattern always does (pieces.py); what else the pattern cuts is
left to the tokenizer library's own expressions, and so are the classes of characters beyond ASCII. Distinct pieces are
merged once and remembered, up to a bound.

Defined cases: null counts as the empty text, which has no ids. Special strings inside texts become their own ids.
Repeated rows are rows. A null doc_id passes through, and doc_id keeps its type. An empty table gives an empty table.
Whole texts, of any length. Other columns may have any name. A vocabulary of another kind is refused (`unlike`).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, remembered, ship
from .pieces import Letters, Memory, Pieces, binary, gathered, pieces, runs

#: Pieces in a generation of a worker's memory, and longest word that goes through the side-by-side trees.
REMEMBERED, SHORT = 120_000, 32
#: Words whose trees stand side by side.
BESIDE = 8192
NONE = (1 << 62) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def unlike(file: dict) -> str:
    """What of a tokenizer file isn't plain byte-level BPE, which alone is built here; empty if nothing."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or odd:
        return "not byte-level BPE with the usual splitting pattern, without normaliser and " + ", ".join(odd or ["prefix"])
    if any(t["lstrip"] or t["rstrip"] or t["content"].split()[1:] or not set(t["content"]) & set("<|>") for t in file["added_tokens"]):
        return "an added token that takes white space or has none of < | >"
    return ""


@dataclass
class Vocabulary:
    """ranks: merged pair of ids -> (rank, id); token: id -> bytes; special: string -> id."""

    pattern: str
    letters: list[int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    token: list[bytes]
    special: dict[str, int]
    keys: object = field(default=None, repr=False)
    digest: str = ""

    @staticmethod
    def read(path: str, pattern: str) -> Vocabulary:
        import numpy as np

        with open(path, encoding="utf-8") as f:  # on the driver; the compiled tables go to the executors
            written = f.read()
        file = json.loads(written)
        if problem := unlike(file):
            raise ValueError(f"{path}: {problem}")
        vocab, letters = file["model"]["vocab"], byte_letters()
        byte = {c: bytes([b]) for b, c in enumerate(letters)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        token = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in vocab.items():
            token[i] = b"".join(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        for t, i in special.items():
            token[i] = t.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        order = sorted((a << 32 | b, r, i) for (a, b), (r, i) in ranks.items())
        return Vocabulary(pattern, [vocab[c] for c in letters], ranks, token, special, np.array(order, np.int64).T.copy(), sha256((pattern + written).encode()).hexdigest())


def merge_word(voc: Vocabulary, word: bytes) -> list[int]:
    """The ids of one word, by one segment tree."""
    ids = [voc.letters[b] for b in word]
    n = len(ids)
    if n < 2:
        return ids
    width = 1 << (n - 1).bit_length()
    after, before, ranks = [*range(1, n), -1], [-1, *range(n - 1)], voc.ranks

    def leaf(i: int) -> int:
        j = after[i]
        found = ranks.get((ids[i], ids[j])) if j >= 0 else None
        return found[0] * width + i if found else NONE

    tree = [NONE] * (2 * width)
    tree[width : width + n] = map(leaf, range(n))
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    alive = [True] * n
    while (root := tree[1]) != NONE:
        left = root % width
        right = after[left]
        ids[left] = ranks[ids[left], ids[right]][1]
        alive[right], after[left] = False, after[right]
        if after[right] >= 0:
            before[after[right]] = left
        for i in (right, left, before[left]):
            if i >= 0:
                k = width + i
                tree[k] = leaf(i) if alive[i] else NONE
                while k := k >> 1:
                    tree[k] = min(tree[2 * k], tree[2 * k + 1])
    return [x for x, a in zip(ids, alive, strict=True) if a]


def merge_words(voc: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """The ids of each word."""
    import numpy as np

    return [np.frombuffer(w, "<i4").tolist() for w in merged(voc, words)]


def merged(voc: Vocabulary, words: list[bytes]) -> list[bytes]:
    """The ids of each word as bytes of 32-bit integers: trees side by side, by width."""
    import numpy as np

    out: list = [None] * len(words)
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if 2 <= len(w) <= SHORT:
            groups.setdefault(1 << (len(w) - 1).bit_length(), []).append(k)
        else:
            out[k] = np.array(merge_word(voc, w), "<i4").tobytes()
    for width, ks in groups.items():
        for at in range(0, len(ks), BESIDE):
            some = ks[at : at + BESIDE]
            flat, ends = _side_by_side(voc, [words[k] for k in some], width)
            for k, a, b in zip(some, [0, *ends], ends, strict=False):
                out[k] = flat[4 * a : 4 * b]
    return out


def _side_by_side(voc: Vocabulary, words: list[bytes], width: int) -> tuple[bytes, list[int]]:
    import numpy as np

    m, (keys, ranks, made) = len(words), voc.keys
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
    size = np.array([len(w) for w in words])
    at = np.arange(width)
    ids = np.where(at < size[:, None], np.array(voc.letters)[raw], -1)
    after = np.where(at + 1 < size[:, None], at + 1, width)  # column `width` is a dump for what isn't there
    after = np.concatenate([after, np.full((m, 1), width)], axis=1)
    before = np.concatenate([np.broadcast_to(at - 1, (m, width)), np.full((m, 1), -1)], axis=1).copy()
    before[:, 0] = width
    ids = np.concatenate([ids, np.full((m, 1), -1)], axis=1)

    def pairs(a, b):
        """Place of each pair in the table, or -1."""
        key = (a << 32) | b
        spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[spot] == key) & (a >= 0) & (b >= 0), spot, -1)

    def leaf(spot, i):
        return np.where(spot >= 0, ranks[spot] * width + i, NONE)

    letters = np.array(voc.letters)
    two = pairs(*np.broadcast_arrays(letters[:, None], letters)) if m > 500 else None  # all pairs of bytes
    spots = pairs(ids[:, :width], np.take_along_axis(ids, after[:, :width], 1)) if two is None else np.where(after[:, :width] < width, two[raw, np.roll(raw, -1, axis=1)], -1)
    tree = np.full((m, 2 * width), NONE)
    tree[:, width:] = leaf(spots, at)
    for k in range(width - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        left = tree[rows, 1] % width
        right = after[rows, left]
        ids[rows, left] = made[pairs(ids[rows, left], ids[rows, right])]
        ids[rows, right] = -1
        far = after[rows, right]
        after[rows, left] = far
        before[rows, far] = left
        ahead = before[rows, left]
        tree[rows, width + right] = NONE
        tree[rows, width + left] = leaf(pairs(ids[rows, left], ids[rows, far]), left)
        some = ahead < width
        tree[rows[some], width + ahead[some]] = leaf(pairs(ids[rows[some], ahead[some]], ids[rows[some], left[some]]), ahead[some])
        ahead = np.where(some, ahead, left)
        for i in (left, right, ahead):
            k = (width + i) >> 1
            while k[0]:
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                k >>= 1
        rows = rows[tree[rows, 1] != NONE]
    ids = ids[:, :width]
    return ids[ids >= 0].astype("<i4").tobytes(), np.cumsum((ids >= 0).sum(axis=1)).tolist()


class Codec:
    """Encodes and decodes texts with a bounded memory of pieces."""

    def __init__(self, voc: Vocabulary, most: int = REMEMBERED) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.voc = voc
        self.split = pre_tokenizers.Split(Regex(voc.pattern), "isolated").pre_tokenize_str
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(voc.special, key=len, reverse=True)) + ")") if voc.special else None
        self.letters = Letters(lambda c: len(self.split(f"x{c}x")) == 1)
        self.words = Memory(most // 2)
        merge = lambda words: merged(voc, words)
        self.pieces = Pieces(most, lambda b: self.letters(b[1:] if b[:1] == " " else b), merge, self._learn)
        self.decimal = pa.array([f"{i},".encode() for i in range(len(voc.token))], pa.large_binary())
        self.token = pa.array(voc.token, pa.large_binary())

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of any pieces: special strings have their own, what the pattern cuts is merged."""
        cut: list[list] = []
        for p in pieces:
            parts = self.marks.split(p.decode("utf-8", "replace")) if self.marks else [p.decode("utf-8", "replace")]
            cut.append([w for s in parts for w in ([s] if s in self.voc.special else [x[0].encode() for x in self.split(s)] if s else [])])
        new = list({w for ws in cut for w in ws if isinstance(w, bytes)})
        known = dict(zip(new, self.words.known(new, lambda ws: merged(self.voc, ws)), strict=True))
        known |= {s: i.to_bytes(4, "little") for s, i in self.voc.special.items()}
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def ids(self, texts):
        """The ids of all texts (large binary) in one array, and the bounds of each text in it."""
        return self.pieces.placed(*pieces(texts))

    def _dealt(self, values, ids, bounds) -> list[memoryview]:
        """The values of each text's ids, one after another."""
        import numpy as np

        out = values.take(pa.array(ids))
        if not len(out):
            return [memoryview(b"")] * (len(bounds) - 1)
        ends, data = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1][bounds].tolist(), memoryview(out.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decimals(self, ids, bounds) -> list[memoryview]:
        """Each text's ids as decimal text joined by commas."""
        return [x[:-1] for x in self._dealt(self.decimal, ids, bounds)]

    def texts(self, ids, bounds) -> list[bytes]:
        """The text of each run of ids, as UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        return [str(x, "utf-8", "replace").encode() for x in self._dealt(self.token, ids, bounds)]

    def encode(self, texts: list[str | None]) -> list[str]:
        """Decimal ids joined by commas, for each text."""
        return [str(x, "ascii") for x in self.decimals(*self.ids(binary(pa.array(texts, pa.string()))))]

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by commas."""
        import numpy as np

        some = np.array(ids.split(",") if ids else [], "<i4")
        return self.texts(some, np.array([0, len(some)]))[0].decode()


def encoded(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text decoded from the ids), round_trip."""
    ship(docs.sparkSession)
    sent, digest = docs.sparkSession.sparkContext.broadcast(voc), voc.digest

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        codec = remembered(digest, Codec, sent.value)
        for rows in gathered(batches, "text"):
            at = 0
            for texts in runs(binary(rows.column("text"))):
                ids, bounds = codec.ids(texts)
                back = codec.texts(ids, bounds)
                cols = [pa.array(np.diff(bounds)), pa.array([sha256(x).hexdigest() for x in codec.decimals(ids, bounds)]), pa.array([sha256(x).hexdigest() for x in back])]
                same = pa.array([a == b.as_py() for a, b in zip(back, texts, strict=True)], pa.bool_())
                yield pa.record_batch([rows.column("doc_id").slice(at, len(texts)), *cols, same], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
                at += len(texts)
        free()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def vocabulary(name: str = "byte_bpe_50k.json") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def query(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def with_tokens(docs: DataFrame, voc: Vocabulary | None = None, name: str = "token_ids") -> DataFrame:
    """docs' columns, and each text's ids as array<int> in a column of this name; with as many underscores behind it as
    make it another name than theirs."""
    ship(docs.sparkSession)
    voc, taken = voc or vocabulary(), {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    sent, digest = docs.sparkSession.sparkContext.broadcast(voc), voc.digest

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = remembered(digest, Codec, sent.value)
        for texts in parts:
            out = []
            for run in runs(binary(texts)):
                found, bounds = codec.ids(run)
                out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        free()

    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    return docs.select(row.alias("row")).select("row.*", ids(F.col("row.text")).alias(name))
