"""Exact substring de-duplication with an FM-index per shard.

Every window of ``width`` words has an anchor, its smallest run of ``anchor`` words by digest,
and equal windows have equal anchors. Anchors that occur twice or more are found by one
aggregation; consecutive windows on one of them form a segment, and segments go to shards by
anchor, so equal windows meet. A shard builds an FM-index of its different segments in the
order of their documents; its segments are then streamed through backward search, and each
reported stretch of ``width`` words is gone if it also starts at a smaller place.

Skew: a task sends each anchor once with its places, and each different segment once (its
later copies in the task are decided there); windows on an anchor that is hot (in more than
``hot`` slices of input) are sharded by their own digest instead of the anchor's.

Windows of words are compared by 64-bit word digests. Ids are integers. Defined cases: a null
text has no words; null ids come before all others; rows of one id are in the order of a
digest of their text, and rows equal in id and text are one document met twice, with equal
results; an empty table gives an empty result; other columns are passed on and may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.fmindex import FMIndex
from kestrel.llm.staging import drop_staged, stage, text_batches, tidied
from kestrel.llm.textarrays import SPACED, Texts, Words, _spans, distinct, mix, ngrams, runs, slices, window_minima, with_field


class Anchored:
    """Words of some texts with the anchor of each window."""

    def __init__(self, texts: Texts, width: int, anchor: int):
        self.words = Words(texts, SPACED)
        self.digest = self.words.digests()
        at, grams = ngrams(self.digest, self.words.first, anchor)
        window, best = window_minima(grams, at, self.words.doc[at], width - anchor + 1)
        self.window, self.anchor = at[window], at[best]  # first words of the window and of its anchor
        self.value = grams[best]


def _anchors(width: int, anchor: int):
    """(anchor, places, n) of a slice's anchors; a place is (document key, word number)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                a = Anchored(texts, width, anchor)
                once = runs(a.anchor)[:-1] if len(a.anchor) else np.empty(0, np.int64)
                at, value = a.anchor[once], a.value[once]
                doc = a.words.doc[at]
                order = np.argsort(value)
                edge = runs(value[order])
                key = np.asarray(part.column(0))[doc]
                places = pa.StructArray.from_arrays([pa.array(key[order]), pa.array((at - a.words.first[doc])[order].astype(np.int32))],
                                                    names=["key", "at"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[order][edge[:-1]].view(np.int64)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), places),
                     pa.array(np.diff(edge))], names=["anchor", "places", "n"])

    return run


def _segments(width: int, anchor: int):
    """Segments of windows on repeated anchors: (shard, id, row, start, windows, words or null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                a = Anchored(texts, width, anchor)
                first = a.words.first
                listed = part.column(3)
                size = np.asarray(listed.value_lengths())
                flat = np.asarray(listed.flatten(), np.int64)
                state = np.zeros(len(a.words) + 1, np.int8)  # 1: repeated anchor, 2: hot
                place = np.repeat(first[:-1], size) + (flat >> 1)
                place = np.minimum(place, len(a.words))
                np.maximum.at(state, place, (1 + (flat & 1)).astype(np.int8))
                take = state[a.anchor] > 0
                window, base, value = a.window[take], a.anchor[take], a.value[take]
                hot = state[base] == 2
                own = _spans(a.digest, window[hot], window[hot] + width, "word")
                shard = mix(value + np.uint64(1))
                shard[hot] = mix(own + np.uint64(2))
                if len(window):
                    split = np.append(True, (base[1:] != base[:-1]) | (window[1:] != window[:-1] + 1) | hot[1:])
                    at = np.append(np.flatnonzero(split), len(window))
                else:
                    at = np.zeros(1, np.int64)
                start, count = window[at[:-1]], np.diff(at)
                shard = shard[at[:-1]]
                doc = a.words.doc[start]
                number = start - first[doc]
                ids, rows = np.asarray(part.column(1))[doc], np.asarray(part.column(2))[doc]
                content = _spans(a.digest, start, start + count + width - 1, "word")
                order = np.lexsort((number, rows, ids, content))
                edge = runs(content[order])
                lead = np.empty(len(start), np.int64)
                lead[order] = np.repeat(order[edge[:-1]], np.diff(edge))
                # the first of equal segments is kept, others are gone; the first's own place in a repeated row is neither
                once = (lead == np.arange(len(start))) | (ids != ids[lead]) | (rows != rows[lead]) | (number != number[lead])
                start, count, shard, doc, number, ids, rows, lead = \
                    (x[once] for x in (start, count, shard, doc, number, ids, rows, lead))
                kept = lead == np.flatnonzero(once)
                # decided segments of one text that follow each other leave as one
                follows = np.zeros(len(start), bool)
                follows[1:] = ~kept[1:] & ~kept[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + count[:-1])
                head = np.flatnonzero(~follows)
                count = np.add.reduceat(count, head) if len(head) else count
                start, number, ids, rows, shard, kept = (x[head] for x in (start, number, ids, rows, shard, kept))
                s, e, raw = a.words.start[start], a.words.end[start + count + width - 2], texts.data.tobytes()
                body = [raw[x:y] if k else None for x, y, k in zip(s.tolist(), e.tolist(), kept.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.view(np.int64)), pa.array(ids), pa.array(rows), pa.array(number), pa.array(count),
                     pa.array(body, pa.binary())], names=["shard", "id", "row", "start", "windows", "words"])

    return run


def _places(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, rows, starts, counts)],
                                      names=["id", "row", "start", "windows"])


def search_shard(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, bodies: Texts, width: int):
    """Runs of gone windows (id, row, start, windows) of a shard's segments."""
    words = Words(bodies, SPACED)
    digest = words.digests()
    content = _spans(digest, words.first[:-1], words.first[1:], "word")
    order = np.lexsort((starts, rows, ids, content))
    edge = runs(content[order])
    lead = np.repeat(order[edge[:-1]], np.diff(edge))
    other = order[(ids[order] != ids[lead]) | (rows[order] != rows[lead]) | (starts[order] != starts[lead])]
    whole = (ids[other], rows[other], starts[other], words.counts()[other] - width + 1)  # copies of an earlier segment
    own = order[edge[:-1]]
    own = own[np.lexsort((starts[own], rows[own], ids[own]))]
    sample, symbol = distinct(digest)
    length = words.counts()[own]
    end = np.cumsum(length + 1) - 1  # each segment is followed by a separator
    begin = end - length
    text = np.zeros(int(end[-1]) + 1 if len(own) else 0, np.int64)
    inside = np.ones(len(text), bool)
    inside[end] = False
    lane = np.repeat(np.arange(len(own)), length)
    text[inside] = symbol[np.repeat(words.first[own], length) + np.arange(len(lane)) - np.repeat(np.cumsum(length) - length, length)] + 1
    index = FMIndex(text, len(sample) + 1, width)
    at, lo, hi = index.matches(text, begin, end)
    gone = np.sort(at[index.earliest(lo, hi) < at])
    segment = np.searchsorted(end, gone)
    cut = np.append(np.flatnonzero(np.append(True, (np.diff(gone) != 1) | (np.diff(segment) != 0))), len(gone)) \
        if len(gone) else np.zeros(1, np.int64)
    head = segment[cut[:-1]]
    some = (ids[own][head], rows[own][head], starts[own][head] + gone[cut[:-1]] - begin[head], np.diff(cut))
    return tuple(np.concatenate(x) for x in zip(whole, some))


def _search(width: int, most_words: int = 1 << 19):
    """Search shard after shard, some small ones in one index."""
    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        body = t.column("words").combine_chunks().cast(pa.large_binary())
        off = np.frombuffer(body.buffers()[1], np.int64)[body.offset: body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[off[0]: off[-1]]
        return _places(*search_shard(*(np.asarray(t.column(c)) for c in ("id", "row", "start")), Texts(data, off - off[0]), width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words, last = 0, None
        for batch in batches:
            plain = batch.column(5).is_null()
            if plain.true_count:
                yield _places(*(np.asarray(batch.filter(plain).column(c)) for c in range(1, 5)))
                batch = batch.filter(pc.invert(plain))
            if not len(batch):
                continue
            shard = np.asarray(batch.column(0))
            load = np.cumsum(np.asarray(batch.column(4)) + width - 1)
            lo = 0
            edge = runs(shard)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if held or a > lo:
                    before = words + (int(load[a - 1]) - (int(load[lo - 1]) if lo else 0) if a > lo else 0)
                    if before >= most_words and shard[a] != (shard[a - 1] if a else last):
                        yield close(held + ([batch.slice(lo, a - lo)] if a > lo else []))
                        held, words, lo = [], 0, a
            held.append(batch.slice(lo))
            words += int(load[-1]) - (int(load[lo - 1]) if lo else 0)
            last = shard[-1]
        if held:
            yield close(held)

    return run


def gone_windows(source: DataFrame, width: int, anchor: int, hot: int) -> DataFrame:
    """(id, row, gone): per document the runs (start, windows) of windows that start earlier elsewhere."""
    keyed = source.select(F.xxhash64("id", "row").alias("key"), "id", "row", "text")
    spark = source.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = keyed.select("key", "text").mapInArrow(tidied(_anchors(width, anchor)), "anchor long, places array<struct<key:long,at:int>>, n long")
    sent = stage(sent, "anchors")
    repeated = sent.groupBy("anchor").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("slices")).filter("n > 1")
    place = sent.join(repeated.select("anchor", (F.col("slices") > hot).cast("int").alias("hot")), "anchor") \
        .select("hot", F.inline("places")).select("key", (F.col("at").cast("long") * 2 + F.col("hot")).alias("place"))
    wanted = stage(place.groupBy("key").agg(F.collect_set("place").alias("places")), "places")  # bounded by the document
    drop_staged(sent)
    some = keyed.join(wanted, "key").select("key", "id", "row", "places", "text")
    segments = some.mapInArrow(tidied(_segments(width, anchor)), "shard long, id long, row long, start long, windows long, words binary")
    shard = F.when(F.col("words").isNull(), F.xxhash64("id", "row", "start")).otherwise(F.col("shard"))
    places = segments.withColumn("shard", shard).repartition(partitions, "shard").sortWithinPartitions("shard") \
        .mapInArrow(tidied(_search(width)), "id long, row long, start long, windows long")
    gone = stage(places, "gone")
    drop_staged(wanted)
    return gone.groupBy("id", "row").agg(F.collect_set(F.struct("start", "windows")).alias("gone"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 20, anchor: int = 8,
                   hot: int = 64) -> DataFrame:
    """Remove every word covered by a window that also starts earlier.

    Returns (whole, n_words, n_removed, kept): ``whole`` is the row itself as a struct, ``kept``
    its remaining words with one blank between them.
    """
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    body = F.coalesce(F.col("whole")[text].cast("string"), F.lit(""))
    named = text_batches(named)
    source = named.select("whole", F.coalesce(F.col("whole")[doc_id].cast("long"), F.lit(-2 ** 63).cast("long")).alias("id"),
                          F.xxhash64(body, F.col("whole")[doc_id].isNull()).alias("row"))
    gone = gone_windows(source.select("id", "row", body.alias("text")), width, anchor, hot)
    joined = source.join(gone, ["id", "row"], "left").select("whole", "gone")  # the text goes along once, in the row

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(with_field(batch, "whole", text, "\0text"), "\0text"):
                words = Words(texts, SPACED)
                n, lists = len(words), part.column(1)
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                pairs = lists.flatten()
                start = np.repeat(words.first[:-1], sizes) + np.asarray(pairs.field(0))
                stop = start + np.asarray(pairs.field(1)) + width - 1
                cover = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
                keep = np.cumsum(cover)[:n] <= 0
                removed = np.bincount(words.doc[~keep], minlength=len(texts))
                left = [words.joined(i, keep[words.first[i]: words.first[i + 1]]) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.counts().astype(np.int64)), pa.array(removed.astype(np.int64)),
                     pa.array(left, pa.binary()).cast(pa.string())], names=["whole", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"whole {named.schema['whole'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def removal_digest(removed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return removed.select(F.col("whole")[doc_id].alias("doc_id"), "n_words", "n_removed",
                          F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
