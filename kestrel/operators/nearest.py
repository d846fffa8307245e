"""The n best matches of every input, with indexes that bound scores before they compute them.

Matches are dealt to shards of bounded load and inputs to chunks; every (chunk, shard) pair is a
task group that holds one shard's index and streams the chunk's inputs through it. Only
the n best of a group leave it, so the shuffle after the search has at most inputs x n x shards
rows, and no key of the data (a hot term, gram or size) is a key of a join. Three indexes:

* ``CosineIndex``: postings of weighted terms in blocks of neighbouring matches with the largest
  weight of each term; blocks are scored in the order of their bound until it is below the n-th best.
* ``GramIndex``: sets of grams in one order, rarest first; an input walks the postings of its
  grams in that order, a bound by sizes and positions discards what cannot be among the n
  best, and the walk ends when a match that shares none of the grams so far cannot either.
* ``EditIndex``: strings of one length cut into one segment more than edits allowed: within that
  radius a match holds a segment of itself at a place shifted by few characters. The radius grows
  until n matches lie inside it.

Scores are compared after rounding to ``DIGITS`` places, ties by match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 4
UNIT = 10.0 ** -DIGITS
SHARD_LOAD, CHUNK_LOAD = 1 << 21, 1 << 18  # terms, grams or characters of a shard's index and of a chunk of inputs
STRING_LOAD = 1 << 18  # characters of a shard whose index holds every segment for every radius


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one after the other."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total) if total else np.empty(0, np.int64)


def best(score: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n highest scores after rounding, ties by ``order``; scores within a hair of a
    rounding edge are kept on both sides of it."""
    if len(score) <= n:
        return np.arange(len(score))
    scaled = score / UNIT + 0.5
    low, high = np.floor(scaled - 1e-6), np.floor(scaled + 1e-6)
    sure = np.lexsort((order, -low))[:n]
    last = sure[-1]
    doubt = (high > low) & ((high > low[last]) | ((high == low[last]) & (order < order[last])))
    return np.union1d(sure, np.flatnonzero(doubt))


def reach(score: np.ndarray, n: int) -> float:
    """The least score that may still be among the n best, given ``score`` of some matches."""
    return -np.inf if len(score) < n else float(np.partition(score, len(score) - n)[len(score) - n]) - UNIT


# ---------------------------------------------------------------------------
# cosine: block-max postings
# ---------------------------------------------------------------------------

class CosineIndex:
    """Weighted terms of a shard's matches, in blocks of ``BLOCK`` neighbours."""

    BLOCK = 32

    def __init__(self, keys: pa.Array, terms: pa.ListArray, weights: pa.ListArray):
        coded = pc.dictionary_encode(terms.flatten())
        self.names = coded.dictionary
        code, weight = np.asarray(coded.indices).astype(np.int64), np.asarray(weights.flatten())
        size = np.asarray(pc.list_value_length(terms)).astype(np.int64)
        begin = np.cumsum(size) - size
        # neighbours share their rarest terms, so that the largest weights of a block are close to its own
        rarity = np.bincount(code, minlength=len(self.names))[code] if len(code) else code
        lead = np.full(len(size), -1)
        if len(code):
            first = np.lexsort((code, rarity, np.repeat(np.arange(len(size)), size)))
            lead[size > 0] = code[first[begin[size > 0]]]
        order = np.argsort(lead, kind="stable")
        at = ragged(begin[order], size[order])
        self.code, self.weight, self.size = code[at], weight[at], size[order]
        self.begin = np.append(0, np.cumsum(self.size))
        names = np.array(keys.to_pylist(), dtype=object)[order]
        self.keys = pa.array(names, pa.string())
        self.order = np.empty(len(names), np.int64)
        self.order[np.argsort(names, kind="stable")] = np.arange(len(names))
        block = np.repeat(np.arange(len(order)) // self.BLOCK, self.size)
        blocks = -(-len(order) // self.BLOCK)
        by = np.argsort(self.code * max(1, blocks) + block, kind="stable")
        pair = (self.code * max(1, blocks) + block)[by]
        edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
        self.top = np.maximum.reduceat(self.weight[by], edge) if len(edge) else np.empty(0)
        self.block = pair[edge] % max(1, blocks)
        self.first = np.searchsorted(pair[edge] // max(1, blocks), np.arange(len(self.names) + 1))
        self.blocks = blocks
        self.query = np.zeros(len(self.names))
        self.scored = 0

    def codes(self, terms: pa.Array) -> np.ndarray:
        return np.asarray(pc.index_in(terms, value_set=self.names).fill_null(-1)).astype(np.int64)

    def search(self, code: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(match, score) of the n best with a score over zero."""
        self.scored = 0
        code, weight = code[code >= 0], weight[code >= 0]
        count = self.first[code + 1] - self.first[code]
        at = ragged(self.first[code], count)
        bound = np.bincount(self.block[at], self.top[at] * np.repeat(weight, count), minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, scores = np.empty(0, np.int64), np.empty(0)
        self.query[code] = weight
        step, done = 4, 0
        while done < len(order):
            part = order[done: done + step]
            part = part[bound[part] >= reach(scores, n)]
            if not len(part):
                break
            done, step = done + len(part), min(2 * step, 256)
            lo = part * self.BLOCK
            docs = ragged(lo, np.minimum(lo + self.BLOCK, len(self.size)) - lo)
            self.scored += len(docs)
            docs = docs[self.size[docs] > 0]
            size = self.size[docs]
            at = ragged(self.begin[docs], size)
            score = np.add.reduceat(self.query[self.code[at]] * self.weight[at], np.cumsum(size) - size) if len(docs) else np.empty(0)
            docs, score = docs[score >= UNIT / 4], score[score >= UNIT / 4]
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, score])
            keep = best(scores, self.order[found], n)
            found, scores = found[keep], scores[keep]
        self.query[code] = 0
        return found, scores

    def answer(self, batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        terms, weights = batch.column("terms"), np.asarray(batch.column("weights").flatten())
        code = self.codes(terms.flatten())
        edge = np.append(0, np.cumsum(np.asarray(pc.list_value_length(terms)))).tolist()
        for a, b in zip(edge, edge[1:]):
            yield self.search(code[a:b], weights[a:b], n)


# ---------------------------------------------------------------------------
# q-gram multisets: prefix filter
# ---------------------------------------------------------------------------

def gram_similarity(name: str, shared, a, b):
    """The measure from the number of shared grams and both sizes (not zero)."""
    if name == "Overlap":
        return shared / np.minimum(a, b)
    if name == "Cosine":
        return shared / np.sqrt(a * b)
    if name in ("Jaccard", "Tversky"):
        return shared / (a + b - shared)
    if name == "Sorensen":
        return 2 * shared / (a + b)
    raise ValueError(name)


class GramIndex:
    """Gram sets (the k-th occurrence of a gram is an element of its own) of a shard's matches."""

    def __init__(self, keys: pa.Array, grams: pa.ListArray, measure: str):
        by = np.argsort(np.array(keys.to_pylist(), dtype=object), kind="stable") if len(keys) else np.empty(0, np.int64)
        keys, grams = keys.take(pa.array(by)), grams.take(pa.array(by))
        self.keys, self.measure, self.order = keys, measure, np.arange(len(keys))
        coded = pc.dictionary_encode(grams.flatten())
        raw = np.asarray(coded.indices).astype(np.int64)
        count = np.bincount(raw, minlength=len(coded.dictionary))
        rare = np.argsort(count, kind="stable")  # grams by frequency: a gram's number is its place in this order
        self.names = coded.dictionary.take(pa.array(rare))
        number = np.empty(len(rare), np.int64)
        number[rare] = np.arange(len(rare))
        self.size = np.asarray(pc.list_value_length(grams)).astype(np.int64)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        code = number[raw]
        inner = np.lexsort((code, owner))
        self.code = code[inner]
        self.begin = np.append(0, np.cumsum(self.size))
        place = np.arange(len(code)) - self.begin[owner]
        post = np.argsort(self.code, kind="stable")
        self.post, self.place = owner[post], place[post]
        self.first = np.searchsorted(self.code[post], np.arange(len(rare) + 1))
        self.sizes = np.unique(self.size[self.size > 0]).astype(np.float64)
        self.query = np.zeros(len(rare), bool)
        self.at = {k: i for i, k in enumerate(keys.to_pylist())}
        self.scored = 0

    def _exact(self, docs: np.ndarray, size: int) -> np.ndarray:
        self.scored += len(docs)
        out = np.zeros(len(docs))
        some = (self.size[docs] > 0) & (size > 0)
        docs = docs[some]
        if len(docs):
            count = self.size[docs]
            at = ragged(self.begin[docs], count)
            shared = np.add.reduceat(self.query[self.code[at]].astype(np.int64), np.cumsum(count) - count)
            out[some] = gram_similarity(self.measure, shared, size, count)
        return out

    def search(self, key: str, code: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(match, score) of the n best; ``code`` are the input's grams that the shard knows."""
        self.scored = 0
        code = np.sort(code)
        self.query[code] = True
        seen = np.zeros(len(self.size), bool)
        found, scores = np.empty(0, np.int64), np.empty(0)
        for i, gram in enumerate(code.tolist()):
            left, least = len(code) - i, reach(scores, n)
            if least > -np.inf and gram_similarity(self.measure, np.minimum(left, self.sizes), size, self.sizes).max(initial=0) < least:
                break
            docs, place = self.post[self.first[gram]: self.first[gram + 1]], self.place[self.first[gram]: self.first[gram + 1]]
            new = ~seen[docs]
            docs, place = docs[new], place[new]
            seen[docs] = True
            most = np.minimum(left, self.size[docs] - place)  # none of the grams before is shared
            docs = docs[gram_similarity(self.measure, most, size, self.size[docs]) >= least]
            if not len(docs):
                continue
            found, scores = np.concatenate([found, docs]), np.concatenate([scores, self._exact(docs, size)])
            keep = best(scores, self.order[found], n)
            found, scores = found[keep], scores[keep]
        if reach(scores, n) <= 0 and len(self.size):  # matches that share nothing may be among the n best: the first by name
            rest = np.setdiff1d(np.arange(min(len(self.size), 2 * n)), found)
            found, scores = np.concatenate([found, rest]), np.concatenate([scores, self._exact(rest, size)])
            same = self.at.get(key)
            if size == 0 and same is not None:  # two equal strings without a gram
                found, scores = np.append(found[found != same], same), np.append(scores[found != same], 1.0)
            keep = best(scores, self.order[found], n)
            found, scores = found[keep], scores[keep]
        self.query[code] = False
        return found, scores

    def answer(self, batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        grams = batch.column("terms")
        code = np.asarray(pc.index_in(grams.flatten(), value_set=self.names).fill_null(-1)).astype(np.int64)
        edge = np.append(0, np.cumsum(np.asarray(pc.list_value_length(grams)))).tolist()
        for key, a, b in zip(batch.column("key").to_pylist(), edge, edge[1:]):
            part = code[a:b]
            yield self.search(key, part[part >= 0], b - a, n)


# ---------------------------------------------------------------------------
# edits: segments of matches, shifted places in the input
# ---------------------------------------------------------------------------

def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of some strings in rows, filled up with -1, and their lengths."""
    size = np.array([len(s) for s in strings], np.int64)
    out = np.full((len(strings), int(size.max(initial=0))), -1, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.repeat(np.arange(len(size)), size), ragged(np.zeros(len(size), np.int64), size)] = flat
    return out, size


def hamming_rows(x: np.ndarray, many: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places where ``x`` differs from each row; the longer one's tail counts."""
    width = min(len(x), many.shape[1])
    inside = np.arange(width) < size[:, None]
    return ((many[:, :width] != x[:width]) & inside).sum(1) + np.abs(size - len(x)) if many.shape[1] else np.abs(size - len(x))


def levenshtein_rows(x: np.ndarray, many: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Edits between ``x`` and each row: bit-parallel in words of 64 letters of ``x``, else row by row."""
    if not len(x) or not many.shape[1]:
        return np.maximum(size, len(x))
    if len(x) > 64:
        step = np.arange(many.shape[1] + 1)
        row = np.broadcast_to(step, (len(many), len(step))).copy()
        for i, letter in enumerate(x.tolist(), 1):
            new = np.empty_like(row)
            new[:, 0] = i
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (many != letter))
            row = np.minimum.accumulate(new - step, axis=1) + step
        return row[np.arange(len(many)), size]
    one = np.uint64(1)
    alphabet, code = np.unique(x, return_inverse=True)
    where = np.zeros(len(alphabet) + 1, np.uint64)
    np.bitwise_or.at(where, code, one << np.arange(len(x), dtype=np.uint64))
    at = np.searchsorted(alphabet, many)
    at[alphabet[np.minimum(at, len(alphabet) - 1)] != many] = len(alphabet)
    up, down = np.full(len(many), ~np.uint64(0)), np.zeros(len(many), np.uint64)
    top, score = np.uint64(len(x) - 1), np.full(len(many), len(x), np.int64)
    for j in range(many.shape[1]):
        match = where[at[:, j]]
        diagonal = (((match & up) + up) ^ up) | match | down
        right_up, right_down = down | ~(diagonal | up), up & diagonal
        live = j < size
        score += live * (((right_up >> top) & one).astype(np.int64) - ((right_down >> top) & one).astype(np.int64))
        right_up = (right_up << one) | one
        up, down = (right_down << one) | ~(diagonal | right_up), right_up & diagonal
    return score


class EditIndex:
    """Strings of a shard by length and, per radius, by segments; indexes of a radius are built when needed."""

    def __init__(self, keys: pa.Array, shifts: bool):
        self.strings = sorted(keys.to_pylist())
        self.keys, self.shifts = pa.array(self.strings, pa.string()), shifts
        self.order = np.arange(len(self.strings))
        self.letter, self.size = letters(self.strings)
        self.lengths = {int(v): np.flatnonzero(self.size == v) for v in np.unique(self.size)}
        self.radii: dict[int, dict] = {}
        self.scored = 0

    def _segments(self, length: int, radius: int) -> list[tuple[int, int]]:
        """(start, length) of radius + 1 segments of nearly one length."""
        cut = [length * i // (radius + 1) for i in range(radius + 2)]
        return [(a, b - a) for a, b in zip(cut, cut[1:])]

    def _index(self, radius: int) -> dict:
        """Matches by (length, number of the segment, segment)."""
        if radius not in self.radii:
            lists: dict[tuple, list[int]] = {}
            for length, members in self.lengths.items():
                if length > 2 * radius:
                    for k, (at, size) in enumerate(self._segments(length, radius)):
                        for m in members.tolist():
                            lists.setdefault((length, k, self.strings[m][at: at + size]), []).append(m)
            self.radii[radius] = {k: np.array(v) for k, v in lists.items()}
        return self.radii[radius]

    def near(self, x: str, radius: int) -> np.ndarray:
        """Every match within ``radius`` edits, and some others."""
        index, out = self._index(radius), []
        for length in range(max(0, len(x) - radius), len(x) + radius + 1):
            if length not in self.lengths:
                continue
            if length <= 2 * radius:  # segments of one letter, or of none, select nothing
                out.append(self.lengths[length])
                continue
            more = len(x) - length
            for k, (at, size) in enumerate(self._segments(length, radius)):
                if self.shifts:  # k edits at most before the segment and radius - k behind it
                    lo = max(0, at - k, at + more - (radius - k))
                    hi = min(len(x) - size, at + k, at + more + (radius - k))
                else:
                    lo = hi = at
                for piece in {x[p: p + size] for p in range(lo, hi + 1)}:
                    hit = index.get((length, k, piece))
                    if hit is not None:
                        out.append(hit)
        mark = np.zeros(len(self.strings), bool)
        for hit in out:
            mark[hit] = True
        return np.flatnonzero(mark)

    def search(self, x: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(match, distance) of the n nearest; the radius grows until that many lie inside it."""
        self.scored = 0
        known = np.zeros(len(self.strings), bool)
        code = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)
        found, far = np.empty(0, np.int64), np.empty(0, np.int64)
        radius, most = 1, max(len(x), int(self.size.max(initial=0)))
        while len(self.strings):
            fresh = self.near(x, radius) if radius < most else np.arange(len(self.strings))
            fresh = fresh[~known[fresh]]
            if len(far) >= n:
                fresh = fresh[np.abs(self.size[fresh] - len(x)) <= np.partition(far, n - 1)[n - 1]]
            known[fresh] = True
            self.scored += len(fresh)
            measure = levenshtein_rows if self.shifts else hamming_rows
            width = int(self.size[fresh].max(initial=0))
            found = np.concatenate([found, fresh])
            far = np.concatenate([far, measure(code, self.letter[fresh, :width], self.size[fresh])])
            if radius >= most or (far <= radius).sum() >= n:
                break
            # a radius that holds n of the known matches is enough: none nearer is missed by it
            grown = 2 * radius
            radius = min(grown, max(radius + 1, int(np.partition(far, n - 1)[n - 1]))) if len(far) >= n else grown
        keep = np.lexsort((found, far))[:n]
        return found[keep], far[keep].astype(np.float64)

    def answer(self, batch: pa.RecordBatch, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for key in batch.column("key").to_pylist():
            yield self.search(key, n)


# ---------------------------------------------------------------------------
# the search over shards and chunks
# ---------------------------------------------------------------------------

def search_groups(build: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], pa.RecordBatch]):
    """Answers of groups (group, kind, ...): the rows of an index (kind 0) first, then what is asked of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, group = None, None
        for batch in batches:
            number, kind = np.asarray(batch.column("group")), np.asarray(batch.column("kind"))
            cut = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1]))).tolist() + [len(batch)]
            for a, b in zip(cut, cut[1:]):
                if number[a] != group:
                    held, index, group = [], None, number[a]
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # a shard without rows
                if index is None:
                    index = build(pa.Table.from_batches(held).combine_chunks())
                yield answer(index, part)

    return run


def dealt(index: DataFrame, asked: DataFrame, shards: int, chunks: int) -> DataFrame:
    """Rows of both tables by (chunk, shard) group, for ``search_groups``.

    ``index`` has a column ``shard`` and goes to every chunk, ``asked`` has ``chunk`` and goes to every
    shard (or has ``shard``, too); their other columns are the same.
    """
    spark = index.sparkSession
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    i = index.withColumn("chunk", every(chunks)).withColumn("kind", F.lit(0))
    a = (asked if "shard" in asked.columns else asked.withColumn("shard", every(shards))).withColumn("kind", F.lit(1))
    both = i.unionByName(a).withColumn("group", F.col("shard") * chunks + F.col("chunk")).drop("shard", "chunk")
    parts = min(shards * chunks, max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return both.repartitionById(parts, F.pmod(F.col("group"), F.lit(parts)).cast("int")).sortWithinPartitions("group", "kind")


def _answers(index, part: pa.RecordBatch, n: int) -> pa.RecordBatch:
    found, scores, scored = [], [], []
    for match, score in index.answer(part, n):
        found.append(match)
        scores.append(score)
        scored.append(index.scored)
    size = np.array([len(f) for f in found])
    owner = np.repeat(np.arange(len(found)), size)
    none = np.flatnonzero(size == 0)  # a row without a match carries the number of scored pairs
    match = index.keys.take(pa.array(np.concatenate(found)))
    first = np.cumsum(size) - size
    work = np.zeros(len(owner), np.int64)
    work[first[size > 0]] = np.array(scored)[size > 0]
    return pa.RecordBatch.from_arrays(
        [part.column("key").take(pa.array(np.append(owner, none))), pa.concat_arrays([match.cast(pa.string()), pa.nulls(len(none), pa.string())]),
         pa.array(np.append(np.concatenate(scores).astype(np.float64), np.full(len(none), np.nan))),
         pa.array(np.append(work, np.array(scored)[none]).astype(np.int64))], names=["input", "match", "score", "scored"])


def nearest(inputs: DataFrame, matches: DataFrame, load: Column, build: Callable[[pa.Table], object], n: int,
            shard_load: int = SHARD_LOAD, chunk_load: int = CHUNK_LOAD) -> DataFrame:
    """(input, match, score, scored): the n best matches of each input in each shard.

    ``inputs`` and ``matches`` have a string ``key`` and the same other columns; ``load`` is
    what a row adds to the size of an index. ``scored`` sums up to the pairs whose score was
    computed; inputs without any match keep a row with a null match.
    """
    spark = inputs.sparkSession
    total = {}
    for name, df in (("shards", matches), ("inputs", inputs)):
        total[name] = df.agg(F.coalesce(F.sum(load), F.lit(0)).cast("long").alias("load"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-total["shards"]["load"] // shard_load))
    tasks = min(spark.sparkContext.defaultParallelism, -(-total["inputs"]["n"] // 64))
    chunks = max(1, -(-total["inputs"]["load"] // chunk_load), -(-tasks // shards))
    own = F.xxhash64("key")
    met = dealt(matches.withColumn("shard", F.pmod(own, F.lit(shards))), inputs.withColumn("chunk", F.pmod(own, F.lit(chunks))), shards, chunks)
    return met.mapInArrow(search_groups(build, lambda index, part: _answers(index, part, n)),
                          "input string, match string, score double, scored long")


def cosine_index(t: pa.Table) -> CosineIndex:
    return CosineIndex(*(t.column(c).combine_chunks() for c in ("key", "terms", "weights")))


def gram_index(measure: str) -> Callable[[pa.Table], GramIndex]:
    return lambda t: GramIndex(t.column("key").combine_chunks(), t.column("terms").combine_chunks(), measure)


def edit_index(shifts: bool) -> Callable[[pa.Table], EditIndex]:
    return lambda t: EditIndex(t.column("key").combine_chunks(), shifts)
