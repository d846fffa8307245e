"""Runs of periodic words by an enhanced suffix array and the branching-tandem test.

The words of each document are numbered, and its suffixes sorted by prefix doubling, with the
longest common prefixes (LCP) of neighbours. The interval of suffixes that share ``d`` words is
cut into children by its boundaries of LCP ``d``; for every suffix ``i`` of all but the largest
child, the ranks of ``i + d`` and ``i - d`` tell whether a square of two times ``d`` words
begins at ``i`` or at ``i - d`` whose next word breaks the period: such a suffix lies in the
interval, but in another child. Each maximal repetition ends with exactly one such square
of its period; rotated to the left while the words agree, the square becomes the run. Squares of
a multiple of the period end at the same place and lie inside the run, so the smallest
period of each end is taken first and those are merged into it. No tree is built.

Documents are worked on in slices of about 2 MB of text, as flat arrays; a longer document is a
slice of its own, in memory that grows with its words (and, for the LCP, with the words
that lie in long repeats). Nothing is shuffled.

Words are numbered by 64-bit digests and compared byte by byte with the first word of the
number. Defined cases: a null text has no words and an empty result text; rows are judged one
by one, so null or repeated ids and repeated rows are no special case; an empty table gives
an empty result; other columns are passed on and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import text_batches
from kestrel.llm.textarrays import SPACED, Texts, Words, distinct, ragged, runs, slices, with_field

PIECE = 1 << 20  # suffixes tested at once


def word_numbers(words: Words) -> np.ndarray:
    """A number for every word, equal for equal words of the slice and only for them."""
    if not len(words):
        return np.empty(0, np.int64)
    sample, number = distinct(words.digests())
    like = sample[number]
    size, data = words.end - words.start, words.texts.data
    same = np.array_equal(size, size[like])
    if same:
        for lo in range(0, len(words), PIECE):
            part = slice(lo, lo + PIECE)
            at, other = ragged(words.start[part], size[part]), ragged(words.start[like[part]], size[part])
            same = same and np.array_equal(data[at], data[other])
    if same:
        return number
    seen: dict[bytes, int] = {}  # two words with one digest
    return np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(words.start.tolist(), words.end.tolist())])


class SuffixArray:
    """Suffixes of every document of a slice, in order, with the LCP of neighbours.

    ``order`` holds document after document; a suffix that is a beginning of another comes
    first. Suffixes with more words in common than ``depth`` of their document stay unordered
    among themselves, with an LCP over that depth.
    """

    def __init__(self, symbol: np.ndarray, first: np.ndarray, depth: np.ndarray):
        n = len(symbol)
        size = np.diff(first)
        self.end = np.repeat(first[1:], size)  # of the document of each word
        self.begin = np.repeat(first[:-1], size)
        limit = np.repeat(depth, size)
        doc = np.repeat(np.arange(len(size)), size)
        key = doc * (int(symbol.max(initial=0)) + 1) + symbol
        self.order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        self.order, live, at = self._grouped(rank, self.order, key[self.order], np.arange(n))
        levels = []  # (width, words in repeats of that width, their ranks)
        width = 1
        while len(live):
            levels.append((width, live, rank[live]))
            go = limit[live] >= width
            live, at = live[go], at[go]
            after = live + width
            inside = after < self.end[live]
            second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
            key = rank[live] * (n + 1) + second
            new = np.argsort(key, kind="stable")
            key, live = key[new], live[new]
            self.order[at] = live
            _, live, at = self._grouped(rank, live, key, at)
            width *= 2
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        self.lcp = self._lcp(levels, n)

    @staticmethod
    def _grouped(rank: np.ndarray, suffix: np.ndarray, key: np.ndarray, at: np.ndarray):
        """Give suffixes in order the place of the first with their key; return those that share one."""
        edge = runs(key)
        size = np.diff(edge)
        rank[suffix] = np.repeat(at[edge[:-1]], size) if len(size) else at
        more = np.repeat(size > 1, size)
        return suffix, suffix[more], at[more]

    def _lcp(self, levels: list, n: int) -> np.ndarray:
        """LCP of each suffix in order with the one before (-1 before the first and behind the last)."""
        out = np.zeros(n + 1, np.int64)
        out[0] = out[n] = -1
        if not levels:
            return out
        pair = np.arange(1, n)
        own = np.arange(n) + n
        _, live, rank = levels[0]
        own[live] = rank
        pair = pair[own[self.order[pair]] == own[self.order[pair - 1]]]
        a, b = self.order[pair - 1].copy(), self.order[pair].copy()
        length = np.zeros(len(pair), np.int64)
        for width, live, rank in reversed(levels):
            own = np.arange(n + 1) + n
            own[live] = rank
            same = np.flatnonzero((own[np.minimum(a, n)] == own[np.minimum(b, n)]) & (a < n) & (b < n))
            a[same] += width
            b[same] += width
            length[same] += width
        out[pair] = length
        return out


def smaller_neighbours(value: np.ndarray, patience: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Nearest place to the left and right with a smaller value (the ends hold the smallest).

    Pointers jump over each other's targets; what a staircase of values leaves open after
    ``patience`` rounds is settled by one scan.
    """
    n = len(value)
    out = []
    for step in (-1, 1):
        to = np.clip(np.arange(n) + step, 0, n - 1)
        open_ = np.arange(1, n - 1)
        for _ in range(patience):
            open_ = open_[value[to[open_]] >= value[open_]]
            if not len(open_):
                break
            to[open_] = to[to[open_]]
        out.append(to)
        if len(open_) and (value[to[open_]] >= value[open_]).any():
            break
    else:
        return out[0], out[1]
    left, right = np.zeros(n, np.int64), np.full(n, n - 1)
    held: list[int] = []
    for k, v in enumerate(value.tolist()):
        while held and value[held[-1]] > v:
            right[held.pop()] = k
        left[k] = held[-1] if held else 0
        if held and value[held[-1]] == v:
            left[k] = left[held[-1]]
        held.append(k)
    # a place followed by an equal value has that value's right neighbour
    for k in reversed(held):
        right[k] = n - 1
    order = np.lexsort((-np.arange(n), value, left))
    same = (left[order][1:] == left[order][:-1]) & (value[order][1:] == value[order][:-1])
    head = np.append(True, ~same)
    right[order] = right[order[np.flatnonzero(head)]][np.cumsum(head) - 1]
    return left, right


def branching_squares(index: SuffixArray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of every square that its next word breaks, up to the documents' depth."""
    lcp, n = index.lcp, len(index.order)
    low, high = smaller_neighbours(lcp)
    k = np.flatnonzero(lcp > 0)
    k = k[lcp[k] <= depth[index.order[k]]]
    if not len(k):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = k[np.lexsort((k, lcp[k], low[k]))]
    group = runs(low[k], lcp[k])
    count = np.diff(group)
    head = group[:-1]
    # children of an interval: from its beginning to the first boundary, and from each boundary to the next
    start = np.insert(k, head, low[k[head]])
    stop = np.append(k[1:], 0)
    stop[group[1:] - 1] = high[k[head]]
    stop = np.insert(stop, head, k[head])
    owner = np.repeat(np.arange(len(count)), count + 1)
    size = stop - start
    edge = np.append(0, np.cumsum(count + 1))
    largest = np.maximum.reduceat(size, edge[:-1])
    full = np.flatnonzero(size == largest[owner])
    full = full[np.append(True, owner[full][1:] != owner[full][:-1])]
    small = np.ones(len(size), bool)
    small[full] = False
    start, stop, size, owner = start[small], stop[small], size[small], owner[small]
    half, lo, hi = lcp[k[head]][owner], low[k[head]][owner], high[k[head]][owner]
    found_at, found_half = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    load = np.cumsum(size)
    cut = 0
    while cut < len(size):
        done = int(load[cut - 1]) if cut else 0
        to = max(cut + 1, int(np.searchsorted(load, done + PIECE, side="right")))
        part = slice(cut, to)
        suffix = index.order[ragged(start[part], size[part])]
        d, a, b, x, y = (np.repeat(v[part], size[part]) for v in (half, lo, hi, start, stop))
        for begin in (suffix, suffix - d):
            other = begin + d if begin is suffix else begin
            ok = other < index.end[suffix] if begin is suffix else other >= index.begin[suffix]
            at = index.rank[np.clip(other, 0, n - 1)]
            ok &= (at >= a) & (at < b) & ((at < x) | (at >= y))
            found_at.append(begin[ok])
            found_half.append(d[ok])
        cut = to
    return np.concatenate(found_at), np.concatenate(found_half)


def rotations(symbol: np.ndarray, begin: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How many words before ``at`` equal the word a period later, without a gap."""
    out = np.zeros(len(at), np.int64)
    live, width = np.flatnonzero(at > begin), 16
    while len(live):
        going = []
        for part in np.array_split(live, -(-len(live) * width // PIECE)):
            x = (at - out)[part][:, None] - 1 - np.arange(width)
            same = (x >= begin[part][:, None])
            np.maximum(x, 0, out=x)
            same &= symbol[x] == symbol[x + period[part][:, None]]
            run = np.where(same.all(1), width, np.argmin(same, 1))
            out[part] += run
            going.append(part[run == width])
        live = np.concatenate(going)
        width = min(2 * width, 4096)
    return out


def find_runs(symbol: np.ndarray, first: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the runs of at least ``least`` words and ``times`` periods, by start and period."""
    size = np.diff(first)
    depth = np.where(size >= least, size // times, 0)
    index = SuffixArray(symbol, first, depth)
    at, half = branching_squares(index, np.repeat(depth, size))
    begin, end = index.begin[at], at + 2 * half
    need = np.maximum(least, times * half) - 2 * half  # rotations that make the square a run
    far = at - np.maximum(need, 0)
    ok = far >= begin
    at, half, begin, end, far = (v[ok] for v in (at, half, begin, end, far))
    ok = symbol[far] == symbol[far + half]
    at, half, begin, end = (v[ok] for v in (at, half, begin, end))
    order = np.lexsort((half, end))
    order = order[runs(end[order], half[order])[:-1]]
    at, half, begin, end = (v[order] for v in (at, half, begin, end))
    out = []
    while len(at):
        head = runs(end)
        lead = head[:-1]
        start = at[lead] - rotations(symbol, begin[lead], at[lead], half[lead])
        length = end[lead] - start
        good = length >= np.maximum(least, times * half[lead])
        out.append((start[good], end[lead][good], half[lead][good]))
        rest = at < np.repeat(start, np.diff(head))  # the others of this end are squares of a multiple
        rest[lead] = False
        at, half, begin, end = (v[rest] for v in (at, half, begin, end))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    start, end, period = (np.concatenate(v) for v in zip(*out))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Runs of periodic words of every row, and its text without their later periods.

    Returns (whole, n_words, runs, kept): ``whole`` is the row as a struct; ``runs`` has (start,
    length, period) of each maximal stretch with smallest period ``period`` and at least ``least``
    words and ``times`` periods, by start and period; ``kept`` the words that no run holds after
    its first period, with one blank between them.
    """
    named = text_batches(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(with_field(batch, "whole", text, "\0text"), "\0text"):
                yield _judged(part, texts, least, times)

    return named.mapInArrow(work, f"whole {named.schema['whole'].dataType.simpleString()}, n_words long, "
                                  "runs array<struct<start:long,length:long,period:long>>, kept string")


def _judged(part: pa.RecordBatch, texts: Texts, least: int, times: int) -> pa.RecordBatch:
    words = Words(texts, SPACED)
    n = len(words)
    start, end, period = find_runs(word_numbers(words), words.first, least, times)
    doc = words.doc[start]
    cover = np.bincount(start + period, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    keep = np.cumsum(cover)[:n] <= 0
    kept = [words.joined(i, keep[words.first[i]: words.first[i + 1]]) for i in range(len(texts))]
    found = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start - words.first[doc], end - start, period)],
                                       names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)), found)
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts().astype(np.int64)), lists,
                                       pa.array(kept, pa.binary()).cast(pa.string())],
                                      names=["whole", "n_words", "runs", "kept"])


def run_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    The four describe the run of the greatest length / period (ties: smallest start, then
    period), by exact products; they are null where there is no run.
    """
    more = "r.length * best.period > best.length * r.period"  # runs come by start and period: ties keep the first
    best = F.expr(f"aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), "
                  f"(best, r) -> CASE WHEN best IS NULL OR {more} THEN r ELSE best END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    done = found.select(F.col("whole")[doc_id].alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
    return done.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def repeat_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with the tail of every tenth document made periodic, by the crc32 of its id.

    With h the crc32 of the decimal id and g = h / 10: where h % 10 = 0 and the text has n > 0
    words, each word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) / (3 +
    g % 8). A null id leaves the text as it is.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), h.alias("h")) \
        .withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))) \
        .withColumn("n", F.size("words")).withColumn("a", F.expr("CASE WHEN n > 0 THEN (h div 10) % n END")) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    tail = F.expr("array_join(transform(words, (w, i) -> CASE WHEN i < a THEN w ELSE words[int(a + (i - a) % p)] END), ' ')")
    return marked.select("doc_id", F.when(F.col("n") > 0, tail).otherwise(F.col("text")).alias("text"))
