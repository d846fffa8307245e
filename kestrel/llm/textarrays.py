"""Whole columns of text as flat byte arrays: words, word digests and n-gram digests.

Used inside ``mapInArrow`` tasks. Texts are handled as UTF-8 bytes and never cut; a batch
is worked on in slices of about ``SLICE_BYTES`` (a longer text is a slice of its own), so
memory is bounded by the slice, not by the Arrow batch. A digest is a 64-bit polynomial
hash over mixed symbols, finished with an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finish of a 64-bit value (every input bit reaches every output bit)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SYMBOL = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_STEP = {"byte": 0xD1342543DE82EF95, "word": 0xA0761D6478BD642F}  # odd, so invertible mod 2^64
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**0 .. step**n and their inverses mod 2^64."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) <= n:
        size, step = 1 << max(12, n.bit_length()), _STEP[kind]
        out = []
        for factor in (step, pow(step, -1, 1 << 64)):
            p = np.full(size, factor, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[kind] = (out[0], out[1])
    return have


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """Digest of values[start:end] for every span."""
    up, down = _powers(kind, len(values))
    total = np.empty(len(values) + 1, _U)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, false in the given inclusive byte ranges (the separators)."""
    table = np.ones(256, bool)
    for lo, hi in ranges:
        table[lo: hi + 1] = False
    return table


#: words of every character but blank, tab, newline, vertical tab, form feed, carriage return
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: words of digits, small letters and every character above ASCII (used after lower-casing A-Z)
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts:
    """Some texts end to end: ``data`` bytes, text i is ``data[off[i]:off[i + 1]]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def lower(self) -> "Texts":
        return Texts(LOWER[self.data], self.off)

    def raw(self, i: int) -> bytes:
        return self.data[self.off[i]: self.off[i + 1]].tobytes()


class Words:
    """Words of some texts: byte spans, text number ``doc``, word range of each text ``first``."""

    def __init__(self, texts: Texts, table: np.ndarray):
        inside = table[texts.data]
        n, off = len(inside), texts.off
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = off[1:]
        after[ends[ends > 0] - 1] = False
        self.texts = texts
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def digests(self) -> np.ndarray:
        return _spans(_SYMBOL[self.texts.data], self.start, self.end, "byte")

    def joined(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The text's words (those with ``keep``), one blank between them."""
        lo, hi = self.first[doc], self.first[doc + 1]
        data, s, e = self.texts.data, self.start[lo:hi], self.end[lo:hi]
        if keep is not None:
            s, e = s[keep], e[keep]
        return b" ".join([data[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())])


def span_digests(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _spans(_SYMBOL[texts.data], starts, ends, "byte")


def ngrams(digests: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of n words inside one text: (position of its first word, digest)."""
    size = len(digests)
    if size < n:
        return np.empty(0, np.int64), np.empty(0, _U)
    ok = np.ones(size, bool)
    ends = first[1:]
    for back in range(1, n):  # a run that starts fewer than n words before its text's end leaves it
        at = ends - back
        at = at[(at >= first[:-1])]
        ok[at] = False
    at = np.flatnonzero(ok)
    return at, _spans(digests, at, at + n, "word")


def window_minima(values: np.ndarray, at: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rightmost minimum of every ``width`` consecutive values of one owner.

    ``at`` are positions of consecutive values (gaps between owners). Returns the index of
    the window's first value and the index of its minimum, for every window.
    """
    n = len(values)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    best = np.arange(n - width + 1)
    low = values[: n - width + 1].copy()
    for k in range(1, width):
        other = values[k: n - width + 1 + k]
        take = other <= low
        best[take] = np.flatnonzero(take) + k
        low[take] = other[take]
    whole = np.flatnonzero(owner[: n - width + 1] == owner[width - 1:])
    return whole, best[whole]


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Bytes and offsets of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]: off[-1]] if raw is not None and off[-1] > off[0] \
        else np.empty(0, np.uint8)
    return Texts(data, off - off[0])


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows whose texts have about ``limit`` bytes together."""
    column = batch.column(batch.schema.get_field_index(text))
    whole = texts_of(column)
    lo, n = 0, len(batch)
    while lo < n:
        hi = int(np.searchsorted(whole.off, whole.off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        part = Texts(whole.data[whole.off[lo]: whole.off[hi]], whole.off[lo: hi + 1] - whole.off[lo])
        yield batch.slice(lo, hi - lo), part
        lo = hi


def with_field(batch: pa.RecordBatch, struct: str, field: str, name: str = "text") -> pa.RecordBatch:
    """The batch with a string field of a struct column as a column of its own (not copied)."""
    column = batch.column(batch.schema.get_field_index(struct))
    part = column.field(column.type.get_field_index(field)).cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, name])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours (all keys), with the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one example of every distinct value, and each value's number among them."""
    order = np.argsort(values)
    edge = runs(values[order])
    which = np.empty(len(values), np.int64)
    which[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    return order[edge[:-1]], which


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts.astype(np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
