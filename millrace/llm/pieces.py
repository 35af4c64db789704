"""Texts as columns of pieces between white space, and the ids of pieces, which are found once and remembered.

A run of texts is cut into pieces and the distinct pieces are numbered, both in Arrow; ids are looked up for each distinct
piece and dealt back to the places where it stands. Most pieces are a body, letters alone, before closing marks, which
splitting patterns part as well, so ids are remembered for bodies and for tails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: ASCII white space; marks that may close a piece, none of which begins a special string.
WHITE, CLOSING = b"\t\n\x0b\x0c\r ", "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
#: Longest piece that is remembered, in bytes; characters of a run of texts.
LONG, RUN = 64, 1 << 22


class Memory:
    """A bounded map in two generations: what the older holds and is asked for again moves to the younger; when that
    is full it becomes the older, and what was not asked for since goes. Long keys are never held."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def known(self, keys: list, make: Callable[[list], Iterable]) -> list:
        """The value of each of the distinct keys; make(list of keys) gives the values of those not held."""
        if max(map(len, keys), default=0) > LONG:
            short, long = [k for k in keys if len(k) <= LONG], [k for k in keys if len(k) > LONG]
            own = dict(zip(long, make(long), strict=True)) | dict(zip(short, self.known(short, make), strict=True))
            return [own[k] for k in keys]
        if new := [k for k in keys if k not in self.young]:
            if len(self.young) + len(new) > self.most:
                self.young, self.old, new = {}, self.young, keys
            self.young.update({k: self.old[k] for k in new if k in self.old})
            if new := [k for k in new if k not in self.young]:
                self.young.update(zip(new, make(new), strict=True))
        return list(map(self.young.__getitem__, keys))


class Letters:
    """Whether a text is letters alone by the tokenizer's own tables: alone(c) says whether the tokenizer leaves a
    character beyond ASCII as one letter. It is asked once for each."""

    def __init__(self, alone: Callable[[str], bool]) -> None:
        self.alone, self.yes, self.no = alone, set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), set()

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return text.isalpha()
        if not self.yes.issuperset(text):
            for c in set(text) - self.yes - self.no:
                (self.yes if ord(c) > 127 and self.alone(c) else self.no).add(c)
        return self.yes.issuperset(text)


def binary(texts):
    """An Arrow array of texts as large binary, null as empty."""
    import pyarrow as pa

    return texts.cast(pa.large_binary()).fill_null(b"")


def pieces(texts):
    """Distinct pieces of texts (large binary), the number of the piece at each place, and the place where each text
    begins, and the end. A piece begins with
    each text and at ASCII white space that follows anything else, so it is white space, then what isn't. None begins
    behind white space beyond ASCII, which belongs to the same run."""
    import numpy as np
    import pyarrow as pa

    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    table = np.zeros(256, bool)
    table[list(WHITE)] = True
    white = table[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = white[1:] & ~white[:-1]
    odd = np.flatnonzero(cut[1:] & (data[:-1] >= 128)) + 1
    if len(odd):  # the last bytes of what may be white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000..., U+3000
        a, b, c = data[odd - 1], data[np.maximum(odd - 2, 0)], data[np.maximum(odd - 3, 0)]
        wide = ((b == 0xC2) & np.isin(a, (0x85, 0xA0))) | ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE2) & np.isin(b, (0x80, 0x81))) | ((c == 0xE3) & (b == 0x80))
        cut[odd[wide]] = False
    cut[ends[:-1][ends[1:] > ends[:-1]]] = True
    begins = np.flatnonzero(cut)
    bounds = np.append(begins, len(data)).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.dictionary_encode()
    return coded.dictionary, coded.indices, np.searchsorted(begins, ends)


def words(texts):
    """As pieces(), of what stands between ASCII white space, without it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts.view(pa.large_string()))
    coded = lists.flatten().view(pa.large_binary()).dictionary_encode()
    return coded.dictionary, coded.indices, np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])


class Pieces:
    """The ids of pieces, as bytes of little-endian 32-bit integers.

    plain(body) says whether a body is letters alone; bodies(list) gives the ids of such bodies, others(list) of any
    pieces. lower: letters of either case have the same ids."""

    def __init__(self, most: int, plain, bodies, others, lower: bool = False) -> None:
        self.plain, self.bodies, self.others, self.lower = plain, bodies, others, lower
        self.held, self.odd, self.tails = Memory(most), Memory(most // 2), {b"": b""}

    def _bodies(self, keys: list[bytes]) -> list[bytes | None]:
        good = [self.plain(k.decode("utf-8", "replace")) for k in keys]
        made = iter(self.bodies([k for k, g in zip(keys, good, strict=True) if g]))
        return [next(made) if g else None for g in good]

    def _tails(self, distinct, sizes):
        """The ids of the marks that close each piece."""
        import numpy as np
        import pyarrow as pa

        closed = np.flatnonzero(sizes)
        found = [p[-n:] for p, n in zip(distinct.take(pa.array(closed)).to_pylist(), sizes[closed].tolist(), strict=True)]
        if new := list(set(found) - self.tails.keys()):
            if len(self.tails) > 100_000:
                self.tails, new = {b"": b""}, list(set(found))
            self.tails.update(zip(new, self.others(new), strict=True))
        number = {t: i for i, t in enumerate(self.tails)}
        which = np.zeros(len(sizes), np.int64)
        which[closed] = [number[t] for t in found]
        return pa.array(list(self.tails.values()), pa.large_binary()).take(pa.array(which))

    def ids(self, distinct):
        """Distinct pieces to their ids, both large binary."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        text = distinct.view(pa.large_string())
        body = pc.ascii_rtrim(pc.ascii_lower(text) if self.lower else text, characters=CLOSING)
        sizes = pc.subtract(pc.binary_length(text), pc.binary_length(body)).to_numpy()
        coded = body.view(pa.large_binary()).dictionary_encode()
        found = pa.array(self.held.known(coded.dictionary.to_pylist(), self._bodies), pa.large_binary()).take(coded.indices)
        out = pc.binary_join_element_wise(found, self._tails(distinct, sizes), pa.scalar(b"", pa.large_binary()))
        if out.null_count:
            odd = distinct.filter(out.is_null()).to_pylist()
            out = pc.replace_with_mask(out, out.is_null(), pa.array(self.odd.known(odd, self.others), pa.large_binary()))
        return out

    def placed(self, distinct, places, firsts):
        """The ids of all places in one array, and the bounds of each text in it."""
        import numpy as np

        out = self.ids(distinct).take(places)
        ends = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1] if len(out) else np.zeros(1, np.int64)
        return np.frombuffer(out.buffers()[2] or b"", "<i4") if len(out) else np.zeros(0, "<i4"), ends[firsts] // 4


def runs(texts, size: int = RUN) -> Iterator:
    """An array of large binary in slices of about size bytes, so that what is held at a time doesn't follow the batch."""
    import numpy as np

    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size)))
        yield texts.slice(at, min(to, len(texts)) - at)
        at = to


def gathered(batches: Iterator, column: str, size: int = RUN) -> Iterator:
    """Record batches put together until the column has about size bytes, so that small ones share their pieces."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(column).nbytes
        if n >= size:
            yield _joined(held, pa)
            held, n = [], 0
    if held:
        yield _joined(held, pa)


def _joined(held: list, pa):
    if len(held) == 1:
        return held[0]
    return pa.record_batch([pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)], schema=held[0].schema)


def some(texts: list, size: int = 1 << 21) -> Iterator[list]:
    """As runs(), of a list of strings or nulls."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run
