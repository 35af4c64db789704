"""Token counts by a compiled tokenizer: deterministic transducers over bytes, chunk state maps, a prefix scan.

The transducer reads a text's bytes and keeps the number of tokens of what it has read, as if the text ended there;
each transition is annotated with the change of that number. Its state joins two machines. The splitter's state says
what kind of word is open (letters, numbers, other marks, white space, a contraction begun). The merger's state says
what any continuation of the open word needs: for each start at which the rest of the word is the beginning of some
vocabulary token, that place in the vocabulary's trie, the token that ends there, and its count. The token that ends
at a byte is the one that forms a valid pair with the token before it, and there is exactly one; so the states are
finite and deterministic. They are compiled when first met and kept in one flat table, up to a bound.

Texts are cut into chunks. A blank after a printable ASCII byte sends every state to one and the same, so the state map
of a chunk is constant from its first such blank on: its body runs from there at once, beside the bodies of all other
chunks, one byte of each at a time. What lies before that blank is the chunk's head. Chunks without such a blank have
state maps on the few states that they may be entered in: that of a fresh text, and those that the maps of the chunk
before lead to. The maps are composed by a parallel prefix scan (pairs, then fours, then eights of chunks); a chunk whose
entry the scan finds outside its map gets it, and all such run together, until the scan goes through. States forget what
lies a token or two back, so that is soon. Heads then run from the exit states that the scan has found.

Defined cases: null counts as the empty text: no bytes, no tokens. Special strings count as one token each. A null
doc_id passes through, and doc_id keeps its type. Repeated rows are rows. An empty table gives an empty table. Whole
texts, of any length. Other columns aren't read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, merge_word, vocabulary
from .common import remembered, ship
from .pieces import WHITE, some

#: Bytes of a chunk; states of the table before it is compiled anew; columns of the table.
CHUNK, STATES, WIDTH = 256, 250_000, 512
LETTER, NUMBER, SPACE, OTHER = range(4)
HOLD = WIDTH - 1
#: Bits of a table entry for the change of the count, which is offset to be positive; most states that the rest can number.
SHIFT, ZERO, NUMBERS = 12, 2048, (1 << 19) - 1
#: Bytes of a long text that are counted at a time where its states are too many for the table.
SEGMENT = 1 << 17


class Merger:
    """Tokens of the prefixes of a word, a byte at a time. A state is a tuple of (trie node, token that ends at the
    start or -1, count there less the count here), in order of starts; the last start is here."""

    def __init__(self, voc: Vocabulary) -> None:
        self.voc = voc
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        made = {i for _, i in voc.ranks.values()} | set(voc.letters)
        for i in made:
            if len(voc.token[i]) < 2 or merge_word(voc, voc.token[i]) == [i]:
                node = 0
                for b in voc.token[i]:
                    if b not in self.next[node]:
                        self.next[node][b] = len(self.next)
                        self.next.append({})
                        self.ends.append(-1)
                    node = self.next[node][b]
                self.ends[node] = i
        # Merge ranks, bytes first, and the halves of each token, for valid().
        self.halves = {i: (a, b) for (a, b), (_, i) in voc.ranks.items()}
        self.rank = {i: r + 256 for r, i in voc.ranks.values()} | {i: n for n, i in enumerate(voc.letters)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.places: dict[tuple, tuple] = {}

    start = ((0, -1, 0),)

    def valid(self, a: int, b: int) -> bool:
        """Whether the texts of a and b, side by side, are encoded as a and b."""
        if a < 0:
            return True
        if (a, b) not in self.pairs:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[a, b] = self._stays(a, b)
        return self.pairs[a, b]

    def _stays(self, a: int, b: int) -> bool:
        """Undoes the merges of both sides of the seam, latest first; at each step the pair at the seam must not have
        been mergeable before the merge that is undone next came (of equal ranks the left one comes first)."""
        rank, halves, ranks = self.rank, self.halves, self.voc.ranks
        before = (float("inf"), 0)  # rank, and 1 if a merge of that rank on the right is the one undone
        while True:
            seam = ranks.get((a, b))
            # A merge at the seam lies right of one of the same rank in a, and left of one in b.
            if seam and (seam[0] + 256 < before[0] or seam[0] + 256 == before[0] and before[1]):
                return False
            left, right = (rank[a] if a in halves else -1), (rank[b] if b in halves else -1)
            if left < 0 and right < 0:
                return True
            if left > right:
                before, a = (left, 0), halves[a][1]
            else:
                before, b = (right, 1), halves[b][0]

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state, and by how much the word's count changes."""
        moved = [(self.next[node][byte], last, rel) for node, last, rel in state if byte in self.next[node]]
        for node, last, rel in moved:
            token = self.ends[node]
            if token >= 0 and self.valid(last, token):
                change, same = rel + 1, self.places.setdefault
                # Places from which no longer token goes on don't matter any more.
                kept = [same(p, p) for n, t, r in moved if self.next[n] for p in [(n, t, r - change)]]
                return (*kept, same(p := (0, token, 0), p)), change
        raise ValueError("a byte has no token")

    def count(self, word: bytes) -> tuple[tuple, int]:
        state, n = self.start, 0
        for b in word:
            state, d = self.step(state, b)
            n += d
        return state, n


class Splitter:
    """The splitting pattern of byte-level vocabularies as a machine over bytes; the state holds the open word's merger
    state. Symbols are bytes; the first byte of a character beyond ASCII comes with the character's class.

    States: ("none",) where any character opens a word; ("run", class, m) in a word of letters, numbers or others;
    ("mark", m) after an apostrophe that opens a word; ("two", x, m) after an apostrophe and r, v or l, so far two
    words; ("white", all, last, d, n, blank): white space, with the merger states of all of it and of its last
    character, the count of all less that of all but the last, the count of the last, and whether that is a blank;
    ("in", state, class): within a character, where state stands before its last byte."""

    def __init__(self, merger: Merger) -> None:
        self.m = merger
        self.long = {"r": ord("e"), "v": ord("e"), "l": ord("l")}

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        byte, kind = (symbol, None) if symbol < 256 else (192 + (symbol - 256) // 4, (symbol - 256) % 4)
        if kind is None:
            if byte >= 128:
                return self._inside(state, byte)
            kind = CLASS[byte]
        fresh, one = self.m.step(Merger.start, byte)
        name = state[0]
        if kind == SPACE:
            if name == "white":
                _, whole, _, _, _, _ = state
                more, d = self.m.step(whole, byte)
                return ("white", more, fresh, d, one, byte == 32), d
            return ("white", fresh, fresh, one, one, byte == 32), one
        change = 0
        if name == "white":
            _, _, _, d, n, blank = state
            change -= d  # what stands before the last character is a word
            if blank:
                m, both = self.m.count(bytes([32, byte]))
                return ("run", kind, m), change + both
            return self._open(byte, kind, fresh), change + n + one
        if name == "mark":
            if chr(byte) in "stmd":
                return ("none",), self.m.count(bytes([39, byte]))[1] - 1
            if chr(byte) in self.long:
                return ("two", chr(byte), fresh), one
            if kind == OTHER:
                more, d = self.m.step(state[1], byte)
                return ("run", OTHER, more), d
            return ("run", kind, fresh), one
        if name == "two":
            if byte == self.long[state[1]]:
                return ("none",), self.m.count(b"'" + state[1].encode() + bytes([byte]))[1] - 2
            if kind == LETTER:
                more, d = self.m.step(state[2], byte)
                return ("run", LETTER, more), d
            return self._open(byte, kind, fresh), one
        if name == "run" and state[1] == kind:
            more, d = self.m.step(state[2], byte)
            return ("run", kind, more), d
        return self._open(byte, kind, fresh), one

    def _open(self, byte: int, kind: int, fresh: tuple) -> tuple:
        return ("mark", fresh) if byte == 39 else ("run", kind, fresh)

    def _inside(self, state: tuple, byte: int) -> tuple[tuple, int]:
        if state[0] == "run":
            more, d = self.m.step(state[2], byte)
            return ("run", state[1], more), d
        _, whole, last, d, n, _ = state
        more, d1 = self.m.step(whole, byte)
        own, d2 = self.m.step(last, byte)
        return ("white", more, own, d + d1, n + d2, False), d1


CLASS = [LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else SPACE if b in WHITE else OTHER for b in range(128)]


class Full(Exception):
    """The table has as many states as its entries can number."""


class Counter:
    """Counts the tokens of texts through the compiled table."""

    def __init__(self, voc: Vocabulary, states: int = STATES) -> None:
        import numpy as np

        from tokenizers import Regex, pre_tokenizers

        self.voc, self.most, self.numbers = voc, states, NUMBERS
        self.split = Splitter(Merger(voc))
        self.cut = pre_tokenizers.Split(Regex(voc.pattern), "isolated").pre_tokenize_str
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(voc.special, key=len, reverse=True))) if voc.special else None
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.runs = 0
        self._reset()

    def _reset(self) -> None:
        import numpy as np

        self.number, self.state = {("none",): 0}, [("none",)]
        self.split.m.places.clear()
        self.column = np.full(WIDTH, -1, np.int32)
        self.column[HOLD] = 0
        self.columns = 1
        self.table = np.full((1024, 64), -1, np.int32)
        self.table[:, 0] = -1
        self.table[0, 0] = ZERO

    def _column(self, symbols) -> object:
        """Table columns of symbols, dealt as symbols are first met."""
        import numpy as np

        found = self.column[symbols]
        if (found < 0).any():
            for s in np.unique(symbols[found < 0]).tolist():
                if self.columns == self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                self.column[s] = self.columns
                self.columns += 1
            self.symbol = {int(c): s for s, c in enumerate(self.column.tolist()) if c >= 0}
            found = self.column[symbols]
        return found

    def _compile(self, state: int, column: int) -> None:
        target, change = self.split.step(self.state[state], self.symbol[column])
        self.table[state, column] = self._number(target) << SHIFT | (change + ZERO)

    def _number(self, state: tuple) -> int:
        """The state's row of the table, which is added where it isn't there."""
        import numpy as np

        if state not in self.number:
            n = len(self.state)
            if n >= self.numbers:
                raise Full
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.number[state] = n
            self.state.append(state)
            self.table[n, 0] = n << SHIFT | ZERO
        return self.number[state]

    def _kind(self, c: str) -> int:
        """The class of a character beyond ASCII, by what the splitting pattern leaves whole."""
        for kind, beside in ((LETTER, "x"), (NUMBER, "1"), (OTHER, ".")):
            if len(self.cut(beside + c + beside)) == 1:
                return kind
        return SPACE

    def _run(self, columns, starts, sizes, states):
        """Runs lanes side by side: lane i reads columns[starts[i]:][:sizes[i]] from states[i]. Exit states, counts."""
        import numpy as np

        order = np.argsort(-sizes, kind="stable")
        starts, sizes, state = starts[order], sizes[order], states[order].astype(np.int64)
        counts = np.zeros(len(order), np.int64)
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")
        for i, n in enumerate(live.tolist()):
            at, column = state[:n], columns[starts[:n] + i]
            got = self.table[at, column]
            if (got < 0).any():
                miss = got < 0
                for key in np.unique(at[miss] << 32 | column[miss]).tolist():
                    self._compile(key >> 32, key & 0xFFFFFFFF)
                got = self.table[at, column]
            state[:n] = got >> SHIFT
            counts[:n] += (got & (2 * ZERO - 1)) - ZERO
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], counts[back]

    def _scan(self, columns, starts, sizes, opens, known):
        """Exit states and counts of chunks in a row, where opens says that a chunk's entry state is known. Maps are
        held as columns: the c-th entry state of each chunk, its exit state and its count."""
        import numpy as np

        n, rows = len(starts), np.arange(len(starts))
        entry = np.where(opens, known, 0)[:, None]
        out, counts = self._run(columns, starts, sizes, entry[:, 0])
        out, counts, path = out[:, None], counts[:, None], np.where(opens, 0, -1)
        while True:
            # For each chunk: the column of its entry that each column of the chunk before leads to; -1 if it has none.
            same = np.concatenate([out[:1], out[:-1]])[:, :, None] == entry[:, None, :]
            lead = np.where(same.any(axis=2), same.argmax(axis=2), -1)
            lead[opens] = 0
            lead, step = np.concatenate([lead, np.full((n, 1), -1)], axis=1), 1  # the last column: -1 leads to -1
            lead[opens, -1] = 0
            while step < n:
                lead[step:] = np.take_along_axis(lead[step:], lead[:-step], axis=1)
                step *= 2
            path = lead[:, -1]
            if (path >= 0).all():
                return out[rows, path], counts[rows, path]
            # A new column: the entry that the chunk before leads to by its path or, where that is open, by its last one.
            last = out[rows, np.where(path >= 0, path, out.shape[1] - 1)]
            news = np.where(path >= 0, entry[rows, path], np.concatenate([last[:1], last[:-1]]))
            held = (entry == news[:, None]).any(axis=1)
            more, got = np.zeros(n, out.dtype), np.zeros(n, np.int64)
            do = np.flatnonzero(~held)
            more[do], got[do] = self._run(columns, starts[do], sizes[do], news[do])
            old = (entry == news[:, None]).argmax(axis=1)
            more, got = np.where(held, out[rows, old], more), np.where(held, counts[rows, old], got)
            entry, out, counts = (np.concatenate([x, y[:, None]], axis=1) for x, y in ((entry, news), (out, more), (counts, got)))

    def _symbols(self, raw, text: str):
        import numpy as np

        symbols = raw.astype(np.int32)
        lead = np.flatnonzero(raw >= 192)
        if len(lead):
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            points = points[points >= 128]
            kinds = self.kinds[points]
            if (kinds == 255).any():
                for p in np.unique(points[kinds == 255]).tolist():
                    self.kinds[p] = self._kind(chr(p))
                kinds = self.kinds[points]
            symbols[lead] = 256 + 4 * (symbols[lead] - 192) + kinds
        return symbols

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Bytes and tokens of each text."""
        if len(self.state) > self.most:
            self._reset()
        try:
            return self._counts(texts)
        except Full:
            self._reset()
            half = len(texts) // 2
            return self.counts(texts[:half]) + self.counts(texts[half:]) if half else [self._long(texts[0] or "")]

    def _parts(self, text: str) -> list[str]:
        """The text between special strings."""
        return self.marks.split(text) if self.marks and self.marks.search(text) else [text]

    def _long(self, text: str) -> tuple[int, int]:
        """As counts, of one text, a segment at a time; between segments the table may be compiled anew."""
        import numpy as np

        parts = self._parts(text)
        tokens = len(parts) - 1
        for part in parts:
            raw, state, at = part.encode(), self.state[0], 0
            while at < len(raw):
                to = min(len(raw), at + SEGMENT)
                while to < len(raw) and raw[to] & 0xC0 == 0x80:
                    to += 1
                if len(self.state) > self.most:
                    self._reset()
                some, size = np.frombuffer(raw[at:to], np.uint8), np.array([to - at])
                total, exit_ = self._core(some, self._column(self._symbols(some, raw[at:to].decode())), size - size, size, self._number(state))
                tokens, state, at = tokens + int(total[0]), self.state[exit_], to
        return len(text.encode()), tokens

    def _counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        import numpy as np

        parts, owner, extra = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            cut = self._parts(t or "")
            extra[i] = len(cut) - 1
            parts += [c for c in cut if c]
            owner += [i for c in cut if c]
        whole = "".join(parts)
        raw = np.frombuffer(whole.encode(), np.uint8)
        sizes = np.array([len(p) if p.isascii() else len(p.encode()) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        total = self._core(raw, self._column(self._symbols(raw, whole)), ends - sizes, ends, 0)[0] if len(raw) else np.zeros(len(parts), np.int64)
        tokens = np.array(extra, np.int64)
        np.add.at(tokens, np.array(owner, np.int64), total)
        lengths = [len(t or "") if (t or "").isascii() else len(t.encode()) for t in texts]
        return list(zip(lengths, tokens.tolist(), strict=True))

    def _core(self, raw, columns, begins, ends, entry: int):
        """The count of each part (begins to ends) of raw, all entered in a state, and the last one's exit state."""
        import numpy as np

        total = np.zeros(len(begins), np.int64)
        # Chunks: about every CHUNK bytes, at the beginning of a character, and wherever a part begins.
        at = np.arange(0, len(raw), CHUNK)
        for _ in range(3):
            at = at[at < len(raw)]
            at = at + (raw[at] & 0xC0 == 0x80)
        at = np.unique(np.concatenate([begins, at[at < len(raw)]]))
        to = np.append(at[1:], len(raw))
        part = np.searchsorted(ends, at, side="right")
        sync = np.flatnonzero((raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)) + 1
        # A part's first byte is where the entry state is; else the first blank that resets, if there is one.
        first = np.append(sync, len(raw))[np.searchsorted(sync, at)]
        opens = at == begins[part]
        first = np.where(opens, at, np.minimum(first, to))
        exits, body = self._run(columns, first, to - first, np.where(opens, entry, 0))
        np.add.at(total, part, body)
        waits, heads = first == to, np.flatnonzero(first > at)
        waiting = heads[waits[heads]]
        if len(waiting):
            exits[waiting], got = self._scan(columns, at[waiting], (to - at)[waiting], np.append(True, np.diff(waiting) > 1), exits[waiting - 1])
            np.add.at(total, part[waiting], got)
        now = heads[~waits[heads]]
        _, got = self._run(columns, at[now], first[now] - at[now], exits[now - 1])
        np.add.at(total, part[now], got)
        return total, int(exits[-1])


def counted(docs: DataFrame, voc: Vocabulary, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    sent, digest = docs.sparkSession.sparkContext.broadcast(voc), voc.digest

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = remembered(digest, Counter, sent.value)
        for batch in batches:
            rows = [x for texts in some(batch.column("text").to_pylist(), 4 << 20) for x in counter.counts(texts)]
            sizes, tokens = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
