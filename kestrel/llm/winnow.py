"""Benchmark decontamination by winnowing.

Documents and benchmark items are sequences of words (A-Z lower-cased; runs of digits,
letters and characters above ASCII). Of every ``span`` consecutive words the smallest
k-gram digest is kept (winnowing), so two texts that share ``span`` words share a kept
digest. The digests of both sides are joined; each hit is then extended over the words
themselves, so a digest only proposes and never decides. An item shorter than ``span``
words is one window: its whole word sequence is its digest, and documents offer their
runs of that length. A bit table of fixed size over the benchmark's digests (at most
``2 ** BITS`` bits, whatever the benchmark's size) drops almost all document digests
before the join.

Defined cases: a null or empty text has no words (no hit, not contaminated); an item
without words has no window; rows of one ``item_id`` are one item, a null id is the item
named by the empty string; document rows equal in id and text get equal results, other
rows that share an id (or have none) are told apart by their text; empty tables give
empty results or no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import stage, text_batches
from kestrel.llm.textarrays import ALNUM, Words, mix, ngrams, slices, texts_of, window_minima

BITS = 23


def _kind(digests: np.ndarray, length: int) -> np.ndarray:
    """Digests of different window lengths kept apart (0: winnowed k-grams)."""
    return mix(digests + np.uint64(length)).view(np.int64)


def _winnowed(digest: np.ndarray, words: Words, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the minimal k-gram of every ``span`` consecutive words, each position once."""
    at, grams = ngrams(digest, words.first, k)
    _, best = window_minima(grams, at, words.doc[at], span - k + 1)
    best = np.unique(best)
    return words.doc[at[best]], _kind(grams[best], 0)


def benchmark_fingerprints(items: DataFrame, k: int, span: int) -> DataFrame:
    """(item, n_words, words, prints): normalised words and the digests of each benchmark row."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = Words(texts.lower(), ALNUM)
                digest, count = words.digests(), words.counts()
                doc, prints = _winnowed(digest, words, k, span)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                out: list[np.ndarray] = []
                for i, n in enumerate(count.tolist()):
                    if 0 < n < span:
                        lo = words.first[i]
                        out.append(_kind(ngrams(digest[lo: lo + n], np.array([0, n]), n)[1], n))
                    else:
                        out.append(np.unique(prints[cut[i]: cut[i + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count.astype(np.int32)),
                     pa.array([words.joined(i).decode() for i in range(len(texts))], pa.string()),
                     pa.array(out, pa.list_(pa.int64()))], names=["item", "n_words", "words", "prints"])

    return items.mapInArrow(make, "item string, n_words int, words string, prints array<long>").filter("n_words > 0")


def _bit_table(prints: DataFrame) -> np.ndarray:
    """Bit table of the digests; what is collected is bounded by 2**BITS small integers."""
    table = np.zeros(1 << BITS, bool)
    place = prints.select((F.col("print").bitwiseAND((1 << BITS) - 1)).cast("int").alias("p")).distinct()
    place = place.groupBy(F.shiftright("p", 15).alias("high")).agg(F.collect_set("p").alias("p"))
    for row in place.toLocalIterator():
        table[row["p"]] = True
    return np.packbits(table, bitorder="little")


def _candidates(docs: DataFrame, table: np.ndarray, short: list[int], k: int, span: int) -> DataFrame:
    """(doc_id, row, n_words, words, prints): the words only of documents with digests left."""
    held = docs.sparkSession.sparkContext.broadcast(table)
    mask = np.uint64((1 << BITS) - 1)

    def maybe(prints: np.ndarray) -> np.ndarray:
        p = prints.view(np.uint64) & mask
        return (held.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                words = Words(texts.lower(), ALNUM)
                digest = words.digests()
                found = [_winnowed(digest, words, k, span)]
                for n in short:
                    at, grams = ngrams(digest, words.first, n)
                    found.append((words.doc[at], _kind(grams, n)))
                doc = np.concatenate([d[m] for d, p in found for m in [maybe(p)]])
                prints = np.concatenate([p[m] for d, p in found for m in [maybe(p)]])
                lists: list = [None] * len(texts)
                kept: list = [None] * len(texts)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(len(texts) + 1))
                for i in np.unique(doc).tolist():
                    lists[i] = np.unique(prints[order[cut[i]: cut[i + 1]]])
                    kept[i] = words.joined(i).decode()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(words.counts().astype(np.int64)),
                     pa.array(kept, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "n_words", "words", "prints"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, row long, n_words long, words string, prints array<long>")


def extend_hits(doc_words: list[str], doc_grams: dict[int, tuple[np.ndarray, np.ndarray]], item_words: list[str],
                span: int, cover: np.ndarray) -> bool:
    """Mark in ``cover`` every document word inside an occurrence of a window of the item."""
    n = min(span, len(item_words))
    at, grams = doc_grams[n]
    words = Words(texts_of(pa.array([" ".join(item_words)])), ALNUM)
    own_at, own = ngrams(words.digests(), words.first, n)
    order = np.argsort(own, kind="stable")
    place = np.searchsorted(own[order], grams)
    place[place == len(own)] = 0
    same = np.flatnonzero(own[order[place]] == grams) if len(own) else np.empty(0, int)
    hit = False
    for p, q in zip(at[same].tolist(), own_at[order[place[same]]].tolist()):
        if doc_words[p: p + n] == item_words[q: q + n]:
            cover[p: p + n] = True
            hit = True
    return hit


def _verify(span: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, counts, names, masks = [], [], [], []
            for text, items in zip(batch.column(2), batch.column(3)):
                doc_words = text.as_py().split(" ")
                words = Words(texts_of(pa.array([text.as_py()])), ALNUM)
                digest = words.digests()
                listed = [(x["item"] or "", x["words"].split(" ")) for x in items.as_py()]
                grams = {n: ngrams(digest, words.first, n) for n in {min(span, len(w)) for _, w in listed}}
                cover = np.zeros(len(doc_words), bool)
                found = {name for name, w in listed if extend_hits(doc_words, grams, w, span, cover)}
                hits.append(int(cover.sum()))
                counts.append(len(found))
                names.append(sorted(found))
                masks.append(np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0])))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(names, pa.list_(pa.string())), pa.array(masks, pa.list_(pa.int32()))],
                names=["doc_id", "row", "n_hit", "n_items", "items", "hit_edges"])

    return check


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", span: int = 13, k: int = 5,
                  percent: int = 5) -> DataFrame:
    """Benchmark words in every document row.

    Returns (doc_id, row, n_words, n_hit, n_items, items, hit_edges, contaminated). ``row`` is
    a digest of the text, ``items`` the sorted ids found, ``hit_edges`` the word positions
    where hit stretches begin and end, alternately. Contaminated: at least ``percent`` in a
    hundred of the words, and any, are hit.
    """
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"),
                         F.col(text).cast("string").alias("text"))
    bench = stage(benchmark_fingerprints(
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                     F.col(item_text).cast("string").alias("text")), k, span), "bench")
    prints = bench.select("item", "words", F.explode("prints").alias("print"))
    short = sorted(r["n_words"] for r in bench.filter(F.col("n_words") < span).select("n_words").distinct().collect())
    read = stage(_candidates(source, _bit_table(prints), short, k, span), "prints")
    key = ["doc_id", "row"]
    offered = read.filter("prints is not null").select(*key, F.explode("prints").alias("print"))
    pairs = offered.join(prints, "print").select(*key, "item", "words").distinct()
    listed = pairs.groupBy(*key).agg(F.collect_list(F.struct("item", "words")).alias("found"))
    texts = read.filter("words is not null").select(*key, "words").dropDuplicates(key)
    kind = source.schema["doc_id"].dataType.simpleString()
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row") == F.col("b.row"))
    checked = texts.alias("a").join(listed.alias("b"), same).select("a.doc_id", "a.row", "a.words", "b.found") \
        .mapInArrow(_verify(span), f"doc_id {kind}, row long, n_hit long, n_items long, items array<string>, "
                                   "hit_edges array<int>")
    out = read.select(*key, "n_words").alias("a").join(checked.alias("b"), same, "left")
    none = F.array().cast("array<string>")
    return out.select("a.doc_id", "a.row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.coalesce("items", none).alias("items"),
                      F.coalesce("hit_edges", F.array().cast("array<int>")).alias("hit_edges"),
                      (F.coalesce(F.col("n_hit"), F.lit(0)) > 0).alias("_any")) \
        .withColumn("contaminated", F.col("_any") & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).drop("_any")


def contamination_digest(found: DataFrame) -> DataFrame:
    """The per-document report with the item list as a digest."""
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
