"""SimHash near-duplicates by tables of distances to pivots.

A document's fingerprint holds in each bit the majority of its shingles' XXH64 values. Equal
fingerprints are one class from the start. A bounded set of fingerprints, drawn by digest,
serves as pivots; every class computes its Hamming distance to each of them. Its cell is
the nearest pivot p; if two fingerprints differ in at most r bits, the distance of one to the other's
pivot is within 2 r of its own least distance, so a class also visits the cells (of lower
number than its own) of all such pivots: every pair within r bits meets in a cell. In a cell
the distances to some of the pivots are the coordinates of a table; by the triangle inequality
a pair whose coordinates differ by more than r anywhere is discarded, and the pairs left are
verified bit by bit. The links of a cell leave it as a spanning forest, and components are
joined over all cells.

Scale: the number of pivots grows with the root of the number of classes (four times, at most
``most_pivots``), so cells and visits grow slower than the classes; pivots are the only thing
collected. A cell of over ``chunk`` classes is dealt to tasks chunk against chunk. Copies of one
fingerprint are one class, and the join back to documents is salted.

Defined cases: a null text or one without words has fingerprint zero, linked like any other;
fewer words than a shingle are one shingle; null ids are kept, and a component with none but
null ids has a null id; rows with one id count each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.components import components
from kestrel.llm.staging import drop_staged, stage, text_batches
from kestrel.llm.textarrays import SPACED, Texts, Words, runs, slices

COORDINATES = 16  # columns of a cell's distance table
_U = np.uint64
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (_U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                      9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def xxh64_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[start:start + size] for every span; long spans one by one."""
    out = np.empty(len(start), _U)
    long = np.flatnonzero(size >= 32)
    if len(long):
        raw = data.tobytes()
        out[long] = [xxhash.xxh64_intdigest(raw[a:a + n], seed) for a, n in zip(start[long].tolist(), size[long].tolist())]
    short = np.flatnonzero(size < 32)
    at, left = start[short], size[short]
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from every place on
    h = left.astype(_U) + _U(seed) + P5
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        h[live] = _turn(h[live] ^ (_turn(eight[at[live]] * P2, 31) * P1), 27) * P1 + P4
        at[live] += 8
        left[live] -= 8
    live = np.flatnonzero(left >= 4)
    h[live] = _turn(h[live] ^ ((eight[at[live]] & _U(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[live] += 4
    left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left > 0)
        h[live] = _turn(h[live] ^ (padded[at[live]].astype(_U) * P5), 11) * P1
        at[live] += 1
        left[live] -= 1
    h = (h ^ (h >> _U(33))) * P2
    h = (h ^ (h >> _U(29))) * P3
    out[short] = h ^ (h >> _U(32))
    return out


def simhashes(texts: Texts, shingle: int, seed: int) -> np.ndarray:
    """Fingerprint of every text."""
    words = Words(texts.lower(), SPACED)
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1  # of each word, where one blank follows every word
    data = np.full(int(end[-1]) + 1 if len(words) else 0, 32, np.uint8)
    inside = np.ones(len(data), bool)
    inside[end] = False
    data[inside] = words.texts.data[SPACED[words.texts.data]]
    count = words.counts()
    pieces = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    edge = np.append(0, np.cumsum(pieces))
    owner = np.repeat(np.arange(len(texts)), pieces)
    head = words.first[owner] + np.arange(len(owner)) - edge[owner]
    last = head + np.minimum(shingle, count[owner]) - 1
    begin = (end - size)[head]
    votes = xxh64_spans(data, begin, end[last] - begin, seed)
    out = np.zeros(len(texts), _U)
    some = np.flatnonzero(pieces)
    for part in np.array_split(some, max(1, -(-len(votes) // (1 << 17)))):
        if not len(part):
            continue
        for group in ([part] if edge[part[-1] + 1] - edge[part[0]] <= 1 << 18 else [part[i: i + 1] for i in range(len(part))]):
            total = np.zeros((len(group), 64), np.int64)
            lo, hi = int(edge[group[0]]), int(edge[group[-1] + 1])
            for a in range(lo, hi, 1 << 18):  # a very long text in steps
                b = min(hi, a + (1 << 18))
                bits = np.unpackbits(votes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                cut = np.clip(edge[group], a, b) - a if len(group) > 1 else np.zeros(1, np.int64)
                total += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
            major = 2 * total > pieces[group][:, None]
            out[group] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(x[:, None] ^ pivots[None, :])


def _cells(pivots: np.ndarray, radius: int):
    """(cell, home, print) of every cell that a fingerprint lives in or visits."""
    step = max(1, (1 << 19) // len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0)).view(_U)
            for lo in range(0, len(x), step):
                part = x[lo: lo + step]
                far = distances(part, pivots)
                home = far.argmin(1)
                least = far[np.arange(len(part)), home]
                reach = far <= least[:, None] + np.uint8(2 * radius)
                reach &= np.arange(len(pivots)) <= home[:, None]
                row, cell = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(cell == home[row]),
                                                  pa.array(part[row].view(np.int64))], names=["cell", "home", "print"])

    return run


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links that join what the given links join: one fewer than members, per component."""
    name, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a):]
    root = np.arange(len(name))
    while True:
        p, q = root[x], root[y]
        differ = p != q
        if not differ.any():
            break
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    member = np.flatnonzero(root != np.arange(len(name)))
    return name[member], name[root[member]]


def close_pairs(own: np.ndarray, other: np.ndarray, pivots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in ``own``, index in ``other``) within ``radius`` bits, in parts.

    Both tables are in the order of their first coordinate, so a run of rows meets a range of
    the other side; the first coordinates are compared for the whole range at once, the rest for
    what is left, and the fingerprints for what no coordinate discards.
    """
    table, rows = distances(own, pivots), distances(other, pivots)
    by_own, by_other = np.argsort(table[:, 0], kind="stable"), np.argsort(rows[:, 0], kind="stable")
    table, rows = table[by_own], rows[by_other]
    lead = table[:, 0].astype(np.int64)
    columns = np.ascontiguousarray(table.T) + np.uint8(radius)
    wide, whole = np.uint8(2 * radius), min(4, len(pivots))
    step = max(1, (1 << 20) // max(1, len(own)))
    for lo in range(0, len(rows), step):
        part = rows[lo: lo + step]
        a, b = np.searchsorted(lead, [int(part[0, 0]) - radius, int(part[-1, 0]) + radius + 1])
        if a == b:
            continue
        near = columns[0, a:b] - part[:, :1] <= wide  # |difference| <= radius, in one unsigned step
        for c in range(1, whole):
            near &= columns[c, a:b] - part[:, c: c + 1] <= wide
        y, x = np.divmod(np.flatnonzero(near), b - a)
        for c in range(whole, len(pivots)):
            keep = columns[c, a + x] - part[y, c] <= wide
            x, y = x[keep], y[keep]
        x, y = by_own[a + x], by_other[lo + y]
        keep = np.bitwise_count(own[x] ^ other[y]) <= radius
        if keep.any():
            yield x[keep], y[keep]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows equal in the first columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = [np.asarray(batch.column(k)) for k in range(keys)]
        edge = runs(*values)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def _links(pivots: np.ndarray, radius: int, most: int = 1 << 20):
    """Links (a, b) of groups (cell, i, j, visits, print): a forest of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            one = pa.Table.from_batches(group)
            visits, prints = (np.asarray(one.column(k).combine_chunks()) for k in (3, 4))
            own, other = prints[visits == 0].view(_U), prints[visits == 1].view(_U)
            inner = one.column(1)[0].as_py() == one.column(2)[0].as_py()
            if not len(own):
                continue
            if inner:
                other = np.concatenate([own, other])
            a, b = np.empty(0, np.int64), np.empty(0, np.int64)
            for x, y in close_pairs(own, other, pivots, radius):
                p, q = own[x].view(np.int64), other[y].view(np.int64)
                differ = p != q
                a, b = np.concatenate([a, p[differ]]), np.concatenate([b, q[differ]])
                if len(a) > most:
                    a, b = spanning_forest(a, b)
            a, b = spanning_forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def close_links(classes: DataFrame, count: int, radius: int, most_pivots: int, chunk: int) -> DataFrame:
    """Links (a, b) that join all ``print`` values of ``classes`` (distinct) within ``radius`` bits."""
    spark = classes.sparkSession
    wanted = min(count, most_pivots, max(16, 4 * isqrt(count)))
    share = int(2 ** 63 * min(1.0, wanted / max(1, count)))
    drawn = classes.filter(F.shiftrightunsigned(F.xxhash64("print"), 1) < F.lit(share)) if wanted < count else classes
    drawn = [r[0] for r in drawn.select("print", F.xxhash64("print").alias("h")).orderBy("h", "print").limit(2 * most_pivots).collect()]
    pivots = np.array(drawn or [0], np.int64).view(_U)
    table = pivots[np.linspace(0, len(pivots) - 1, min(COORDINATES, len(pivots))).astype(np.int64)]
    dealt = stage(classes.select("print").mapInArrow(_cells(pivots, radius), "cell int, home boolean, print long"), "cells")
    chunks = F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")
    sizes = F.broadcast(dealt.groupBy("cell").agg(chunks))  # a row per pivot at most
    rows = dealt.join(sizes, "cell").withColumn("c", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    meet = F.when(F.col("home"), F.transform(other, lambda o: F.struct(  # as a home of its chunk, and as a visitor of smaller ones
        F.col("c").alias("i"), o.alias("j"), F.lit(0).alias("visits")))).otherwise(F.transform(other, lambda o: F.struct(
            o.alias("i"), F.col("c").alias("j"), F.lit(1).alias("visits"))))
    also = F.filter(F.transform(other, lambda o: F.struct(o.alias("i"), F.col("c").alias("j"), F.lit(1).alias("visits"))),
                    lambda m: F.col("home") & (m["i"] < F.col("c")))
    rows = rows.select("cell", "print", F.explode(F.concat(meet, also)).alias("m")).select("cell", "m.i", "m.j", "m.visits", "print")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = stage(rows.repartition(partitions, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
                  .mapInArrow(_links(table, radius), "a long, b long").distinct(), "links")
    drop_staged(dealt)
    return links


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42,
                       radius: int = 3, most_pivots: int = 1 << 14, chunk: int = 1 << 15, salts: int = 8) -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``radius`` bits.

    Returns (doc_id, fingerprint, component_id): 16 hexadecimal digits, and the smallest id of
    the component.
    """
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(simhashes(texts, shingle, seed).view(np.int64))],
                                                 names=["doc_id", "print"])

    member = stage(source.mapInArrow(printed, f"doc_id {kind}, print long"), "prints")
    classes = stage(member.groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    label = components(close_links(classes, classes.count(), radius, most_pivots, chunk))
    group = F.coalesce("component", "print")
    joined = classes.join(label.withColumnRenamed("node", "print"), "print", "left").withColumn("group", group)
    smallest = joined.groupBy("group").agg(F.min("low").alias("component_id"))
    named = joined.filter("n > 1 OR component IS NOT NULL").join(smallest, "group") \
        .select("print", "component_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = member.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    out = salted.join(named.withColumn("found", F.lit(True)), ["print", "salt"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
