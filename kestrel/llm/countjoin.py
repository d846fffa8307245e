"""N-gram Jaccard join with R-trees over count vectors.

The shingles of a document are hashed into groups. Two sets that link differ in at most
``(n_a + n_b) (100 - p) / (100 + p)`` shingles, so with more groups than that one group is
the same in both: documents meet in the blocks of their (size band, group, digest of the
group's shingles). Only blocks of two or more different sets matter, and blocks with equal
members are one block. Coarser groups make the count vector of a document, a point; the sum
of coordinate minima of two points (or of a point and an R-tree box) bounds their overlap
from above, and only pairs over the bound are verified on the sets themselves.

Equal sets are one class from the start. A block first compares every class with its
smallest; after these links are joined to components, only blocks whose members still lie in
different components are searched, by an R-tree join, and only across components. So no
link between components is missed, and a group of copies is never compared pair by pair.

Words and shingles are told apart by 64-bit digests. Defined cases: a null text or one
without words has an empty set and links with nothing; fewer words than a shingle are one
shingle; null ids are kept, and a component with none but null ids has a null id; rows with
one id count each, with equal sets in one class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.components import components
from kestrel.llm.staging import stage, text_batches, tidied
from kestrel.llm.textarrays import SPACED, Texts, Words, _spans, mix, ngrams, ragged, runs, slices

LEAST_DIMENSIONS, MOST_DIMENSIONS = 64, 1 << 16  # coordinates of a count vector
COARSE = 256  # coordinates at most of the points that travel with blocks and pairs
_U = np.uint64


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of distinct shingles of each text, their text, their digests), by text."""
    words = Words(texts.lower(), SPACED)
    digest, count = words.digests(), words.counts()
    at, grams = ngrams(digest, words.first, size)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        whole = _spans(digest, words.first[few], words.first[few] + count[few], "word")
        doc, grams = np.concatenate([words.doc[at], few]), np.concatenate([grams, whole])
    else:
        doc = words.doc[at]
    order = np.argsort(grams)
    small = doc[order].astype(np.uint16) if len(texts) < 1 << 16 else doc[order]
    order = order[np.argsort(small, kind="stable")]
    doc, grams = doc[order], grams[order]
    keep = runs(doc, grams)[:-1]
    doc, grams = doc[keep], grams[keep]
    return np.bincount(doc, minlength=len(texts)), doc, grams


def class_digests(n: np.ndarray, doc: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Digest of each set (order does not matter)."""
    total = np.zeros(len(n), _U)
    np.add.at(total, doc, mix(grams ^ _U(0x5851F42D4C957F2D)))
    return mix(total + n.astype(_U)).view(np.int64)


def most_difference(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    """Largest number of shingles in which linking sets of at most these sizes differ."""
    return (small + large) * (100 - percent) // (100 + percent)


def signatures(n: np.ndarray, doc: np.ndarray, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of every group a text may share with a linking one.

    Band j holds sizes 2**j to 2**(j + 1) - 1. A pair uses the groups of its larger set's
    band, so a text also takes those of the next band if it can link into it.
    """
    mixed, out_doc, out_sig = mix(grams), [], []
    band = np.zeros(len(n), np.int64)
    band[n > 0] = np.floor(np.log2(n[n > 0] + 0.5)).astype(np.int64)
    for step in (0, 1):
        scheme = band + step
        uses = (n > 0) if step == 0 else (n > 0) & (100 * n >= percent * (1 << scheme))
        top = (2 << scheme) - 1
        groups = np.where(uses, most_difference(top, top, percent) * 11 // 10 + 2, 0)
        base = np.cumsum(groups) - groups
        mine = uses[doc]
        own = doc[mine]
        slot = base[own] + ((mixed[mine] >> _U(11)) % groups[own].astype(_U)).astype(np.int64)
        total = np.zeros(int(groups.sum()), _U)
        np.add.at(total, slot, mixed[mine] * _U(0xC2B2AE3D27D4EB4F) + _U(1))
        owner = np.repeat(np.arange(len(n)), groups)
        number = np.arange(len(owner)) - base[owner]
        filled = total != 0
        partner = np.minimum(100 * n // percent, top)
        short = np.bincount(owner[filled], minlength=len(n)) <= most_difference(n, partner, percent)
        take = filled | short[owner]  # with so few filled groups, equal empty ones must count too
        salt = (scheme[owner[take]] << 40 | number[take]).astype(_U)
        out_doc.append(owner[take])
        out_sig.append(mix(total[take] + mix(salt + _U(7))))
    return np.concatenate(out_doc), np.concatenate(out_sig)


def _packed(size: int, percent: int, buckets: int):
    """Signatures with their classes as byte strings per bucket of signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                n, doc, grams = shingle_sets(texts, size)
                own = class_digests(n, doc, grams)
                _, once = np.unique(own, return_index=True)  # equal sets of the slice send one copy
                first = np.zeros(len(n), bool)
                first[once] = True
                row, sig = signatures(np.where(first, n, 0), doc[first[doc]], grams[first[doc]], percent)
                bucket = ((sig >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                order = np.lexsort((row, bucket))
                row, sig, bucket = row[order], sig[order], bucket[order]
                edge = runs(bucket)
                ids, data = [], []
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    part = runs(row[a:b])  # one class, then its signatures in the bucket
                    names, counts = own[row[a:b][part[:-1]]], np.diff(part).astype(np.uint32)
                    ids.append(int(bucket[a]))
                    data.append(np.uint32(len(names)).tobytes() + names.tobytes() + counts.tobytes() + sig[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    names = np.frombuffer(raw, np.int64, n, 4)
    counts = np.frombuffer(raw, np.uint32, n, 4 + 8 * n)
    return np.repeat(names, counts), np.frombuffer(raw, _U, -1, 4 + 12 * n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of every block with two or more classes, equal blocks of the task once."""
    seen: set[int] = set()

    def close(parts: list[bytes]) -> pa.RecordBatch:
        names, sigs = map(np.concatenate, zip(*map(_unpack, parts)))
        order = np.argsort(sigs)
        names, sigs = names[order], sigs[order]
        edge = runs(sigs)
        size = np.diff(edge)
        inside = np.repeat(size > 1, size)
        names, sigs = names[inside], sigs[inside]
        order = np.lexsort((names, sigs))
        names, sigs = names[order], sigs[order]
        once = runs(sigs, names)[:-1]  # copies from different slices
        names, sigs = names[once], sigs[once]
        edge = runs(sigs)
        size = np.diff(edge)
        block = np.zeros(0, _U)
        if len(size):
            block = mix(np.add.reduceat(mix(names.view(_U)), edge[:-1]) + size.astype(_U))
        fresh = np.array([n > 1 and b not in seen for b, n in zip(block.tolist(), size.tolist())], bool)
        if len(seen) > 500_000:
            seen.clear()
        seen.update(block[fresh].tolist())
        _, first = np.unique(block, return_index=True)
        keep = np.zeros(len(block), bool)
        keep[first] = True
        keep &= fresh
        at = ragged(edge[:-1][keep], size[keep])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(block[keep].view(np.int64), size[keep])), pa.array(names[at]),
             pa.array(np.repeat(names[edge[:-1]][keep], size[keep]))], names=["block", "class", "low"])

    held, bucket = [], None
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != bucket and held:
                yield close(held)
                held = []
            bucket = b
            held.append(raw.as_py())
    if held:
        yield close(held)


def count_vector(grams: np.ndarray) -> np.ndarray:
    """Group counts of a set: at least two coordinates a shingle, so that few shingles that
    differ meet in one and the bound is close to the overlap."""
    n = len(grams)
    size = min(MOST_DIMENSIONS, max(LEAST_DIMENSIONS, 1 << max(0, 2 * n - 1).bit_length()))
    return np.bincount((mix(grams) & _U(size - 1)).astype(np.int64), minlength=size)


def pack_point(point: np.ndarray) -> bytes:
    width = 1 if point.max(initial=0) < 1 << 8 else 2 if point.max() < 1 << 16 else 4
    return bytes([width]) + point.astype(f"<u{width}").tobytes()


def unpack_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", -1, 1)


def fold(points: np.ndarray, size: int) -> np.ndarray:
    """Points with fewer coordinates (groups by the low bits of the same digests)."""
    return points if points.shape[1] == size else points.reshape(len(points), -1, size).sum(1, dtype=np.uint32)


def shared(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Sum of coordinate minima over the last axis; no sum is over ``most`` (a set's size)."""
    return np.minimum(a, b).sum(-1, dtype=np.uint16 if most < 1 << 16 else np.int64).astype(np.int64)


def overlap_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sum of coordinate minima of each pair of packed points."""
    x, y = list(map(unpack_point, a)), list(map(unpack_point, b))
    sizes = np.array([[len(p), len(q)] for p, q in zip(x, y)]).reshape(-1, 2)
    out = np.zeros(len(x), np.int64)
    for m, n in np.unique(sizes, axis=0).tolist():
        rows = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        for part in np.array_split(rows, -(-len(rows) * max(m, n) // (1 << 20))):
            least = min(m, n)
            out[part] = np.minimum(fold(np.stack([x[r] for r in part]), least), fold(np.stack([y[r] for r in part]), least)).sum(1, dtype=np.int64)
    return out


def _class_sets(size: int):
    """(class, n, shingles) of (class, text) rows whose text is of that class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                n, doc, grams = shingle_sets(texts, size)
                cut = np.append(0, np.cumsum(n))
                own, wanted = pa.array(class_digests(n, doc, grams)), part.column(0)
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(grams.view(np.int64)))
                out = pa.RecordBatch.from_arrays([own, pa.array(n.astype(np.int32)), lists], names=["class", "n", "shingles"])
                yield out.filter(pc.or_(pc.is_null(wanted), pc.equal(wanted, own).fill_null(False)))

    return run


def may_link(n_a: np.ndarray, n_b: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """100 |a & b| >= percent |a | b|, for an overlap or a bound of it."""
    return 100 * overlap >= percent * (n_a + n_b - overlap)


class CountTree:
    """R-tree over count vectors: packed by size, then by the widest coordinates."""

    FANOUT = 16

    def __init__(self, points: np.ndarray, n: np.ndarray):
        widest = np.argsort(-points.std(0), kind="stable")[:2]
        self.order = np.lexsort((points[:, widest[1]], points[:, widest[0]] // 8, n))
        self.points, self.n = points[self.order], n[self.order]
        self.levels = []  # from the leaves' boxes up: (coordinate maxima, least n, most n)
        top, least, most = self.points, self.n, self.n
        while len(top) > 1:
            at = np.arange(0, len(top), self.FANOUT)
            top = np.maximum.reduceat(top, at)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((top, least, most))

    def search(self, point: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Members whose overlap bound with the point allows a link."""
        if not self.levels:
            nodes = np.zeros(1, np.int64)
        else:
            nodes = np.arange(len(self.levels[-1][0]))
            for depth in range(len(self.levels) - 1, -1, -1):
                top, least, most = self.levels[depth]
                # a member of size m in the box has at most min(sum of minima, n, m) shared shingles
                bound = np.minimum(shared(top[nodes], point, n), np.minimum(n, most[nodes]))
                nodes = nodes[may_link(n, np.maximum(bound, least[nodes]), bound, percent)]
                below = len(self.levels[depth - 1][0]) if depth else len(self.points)
                nodes = ragged(nodes * self.FANOUT, np.minimum(self.FANOUT, below - nodes * self.FANOUT))
        overlap = shared(self.points[nodes], point, n)
        return self.order[nodes[may_link(n, self.n[nodes], overlap, percent)]]


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Groups of rows equal in the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = [np.asarray(batch.column(k)) for k in range(keys)]
        edge = runs(*values)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def block_pairs(points: list[np.ndarray], n: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray,
                percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left and right members) over the bound, across labels.

    Members are indexed by the size of their points. Sets that link are of similar size, so
    a member meets the tree of its own point size and, folded, that of half of it.
    """
    size = np.array([len(p) for p in points])
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def meet(query: np.ndarray, member: np.ndarray, coordinates: int) -> None:
        if not len(query) or not len(member):
            return
        q = np.concatenate([fold(points[r][None], coordinates) for r in query])
        m = np.stack([points[r] for r in member])
        if len(member) * coordinates <= 1 << 18:  # no more than a leaf holds: all bounds at once, in runs of queries
            step = max(1, (1 << 21) // (len(member) * coordinates))
            for lo in range(0, len(query), step):
                over = may_link(n[query[lo: lo + step]][:, None], n[member][None],
                                shared(q[lo: lo + step, None], m[None], int(n[query].max())), percent)
                x, y = np.nonzero(over)
                found_a.append(query[lo + x])
                found_b.append(member[y])
        else:
            tree = CountTree(m, n[member])
            for r, p in zip(query.tolist(), q):
                hit = member[tree.search(p, int(n[r]), percent)]
                found_a.append(np.full(len(hit), r))
                found_b.append(hit)

    for coordinates in np.unique(size).tolist():
        own = size == coordinates
        for a, b in ((left, right),) if left is right else ((left, right), (right, left)):
            if a is left:
                meet(a[own[a]], b[own[b]], coordinates)
            meet(a[size[a] == 2 * coordinates], b[own[b]], coordinates)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = label[a] != label[b]
    return a[keep], b[keep]


def central(points: list[np.ndarray], n: np.ndarray, count: int) -> np.ndarray:
    """Members whose points lie closest to the mean point, the most likely to link with many."""
    size = min(len(p) for p in points)
    folded = np.concatenate([fold(p[None], size).astype(np.float32) for p in points])
    near = np.minimum(folded, folded.mean(0)).sum(1) / np.maximum(n, 1)
    return np.argsort(-near, kind="stable")[:count]


def _tree_join(percent: int, centres: int = 0):
    """Pairs of a group of (block, i, j, side, class, label, n, point) over the bound, across labels;
    with ``centres`` only those of that many central members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []

        def pairs() -> pa.RecordBatch:
            """Pairs of some blocks, each once."""
            pair = np.unique(np.concatenate(found), axis=0)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for group in _sorted_groups(batches, 3):
            side, name, label, n = (np.asarray(group.column(k)) for k in (3, 4, 5, 6))
            left = np.flatnonzero(side == 0)
            right = left if group.column(1)[0].as_py() == group.column(2)[0].as_py() else np.flatnonzero(side == 1)
            points = [unpack_point(x) for x in group.column(7).to_pylist()]
            if centres:
                left, right = central(points, n, centres), np.arange(len(n))
            a, b = (name[x] for x in block_pairs(points, n, label, left, right, percent))
            found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
            if sum(map(len, found)) > 1 << 20:
                yield pairs()
        if found:
            yield pairs()

    return run


def _bounded(percent: int):
    """Pairs (a, b, n_a, point_a, n_b, point_b) whose bound allows a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = overlap_bounds(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            ok = may_link(np.asarray(batch.column(2)), np.asarray(batch.column(4)), bound, percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link, by the exact overlap of their sets."""
    side = {s: sets.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("shingles").alias(f"set_{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("o", overlap).filter(100 * F.col("o") >= percent * (F.col("n_a") + F.col("n_b") - F.col("o"))) \
        .select("a", "b")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                       chunk: int = 2048, with_rows: bool = False) -> DataFrame:
    """Components of documents linked by a shingle Jaccard similarity of ``percent`` or more.

    Returns (doc_id, n_shingles, component_id): the component is named by its smallest id.
    Blocks with more than ``chunk`` members are searched chunk against chunk, in tasks of their own.
    ``with_rows`` adds (row, first): a digest of the text, and whether this row represents its
    component (the smallest id, null ids last, then the smallest digest).
    """
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark, kind = docs.sparkSession, source.schema["doc_id"].dataType.simpleString()

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                n, doc, grams = shingle_sets(texts, shingle)
                cut = np.append(0, np.cumsum(n)).tolist()
                vectors = [count_vector(grams[a:b]) for a, b in zip(cut, cut[1:])]
                coarse = [pack_point(fold(v[None], min(len(v), COARSE))[0]) for v in vectors]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n.astype(np.int64)),
                                                  pa.array(class_digests(n, doc, grams)), pa.array(list(map(pack_point, vectors)), pa.binary()),
                                                  pa.array(coarse, pa.binary())], names=["doc_id", "row", "n", "class", "point", "coarse"])

    member = source.select("doc_id", "text", F.xxhash64("text").alias("row")) \
        .mapInArrow(tidied(sized), f"doc_id {kind}, row long, n long, class long, point binary, coarse binary")
    member = stage(member, "classes")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = source.select("text").mapInArrow(tidied(_packed(shingle, percent, 16 * partitions)), "bucket int, data binary")
    blocks = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket") \
        .mapInArrow(tidied(_blocks), "block long, class long, low long")
    blocks = stage(blocks.distinct(), "blocks")
    light = stage(member.filter("n > 0").select("class", "n", F.col("coarse").alias("point")).dropDuplicates(["class"]), "points")
    fine = member.filter("n > 0").select("class", "n", "point")

    def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
        """Pairs whose points allow a link."""
        both = pairs
        for s in "ab":
            both = both.join(points.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("point").alias(f"p_{s}")), s)
        return both.select("a", "b", "n_a", "p_a", "n_b", "p_b").mapInArrow(tidied(_bounded(percent)), "a long, b long")

    def by_fine_points(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose fine points, fetched for these alone, allow a link."""
        some = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        return stage(bounded(pairs, fine.join(some, "class", "left_semi").dropDuplicates(["class"])), name)

    star = blocks.filter("class <> low").select(F.least("class", "low").alias("a"), F.greatest("class", "low").alias("b")).distinct()
    near = by_fine_points(stage(bounded(star, light), "near"), "near")

    def sets_of(classes: DataFrame, name: str) -> DataFrame:
        """Sets of one text of every class, of which only these texts are read again."""
        named = member.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(classes, "class")
        texts = source.join(named.filter("doc_id is not null").select("doc_id", "class"), "doc_id").select("class", "text")
        schema = "class long, n int, shingles array<long>"
        unnamed = source.filter("doc_id is null").select(F.lit(None).cast("long").alias("class"), "text") \
            .mapInArrow(_class_sets(shingle), schema) \
            .join(named.filter("doc_id is null").select("class"), "class", "left_semi").dropDuplicates(["class"])
        return stage(texts.mapInArrow(_class_sets(shingle), schema).unionByName(unnamed), name)

    def classes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()

    sets = sets_of(classes_of(near), "sets")
    links = stage(_verified(near, sets, percent), "star")
    label = components(links)

    def open_rows(label: DataFrame) -> DataFrame:
        """Members of the blocks whose classes still lie in different components, dealt to chunk pairs."""
        marked = stage(blocks.join(label.withColumnRenamed("node", "class"), "class", "left")
                       .withColumn("label", F.coalesce("component", "class")).select("block", "class", "label"), "marked")
        split = marked.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members")) \
            .filter("x <> y").select("block", F.ceil(F.col("members") / chunk).cast("int").alias("chunks"))
        rows = marked.join(split, "block").join(light, "class") \
            .withColumn("c", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
            F.least("c", o).alias("i"), F.greatest("c", o).alias("j"), (F.col("c") > o).cast("int").alias("side"))))
        return rows.select("block", "class", "label", "n", "point", meet.alias("m")) \
            .select("block", F.col("m.i").alias("i"), F.col("m.j").alias("j"), F.col("m.side").alias("side"), "class", "label", "n", "point")

    def candidates(rows: DataFrame, checked: DataFrame, centres: int, name: str) -> DataFrame:
        met = rows.repartition(partitions, "block", "i", "j").sortWithinPartitions("block", "i", "j") \
            .mapInArrow(tidied(_tree_join(percent, centres)), "a long, b long").distinct()
        return stage(met.join(checked, ["a", "b"], "left_anti"), name)

    def merged(label: DataFrame, links: DataFrame) -> DataFrame:
        """Components (node, component) after more links between them."""
        both = label.toDF("node", "parent")
        over = components(links.join(both.toDF("a", "pa"), "a", "left").join(both.toDF("b", "pb"), "b", "left")
                          .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
        old = label.join(over.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        return stage(old.unionByName(over.join(label.select("node"), "node", "left_anti")), "merged")

    # central members first: they join most of a group whose smallest member is an outlier
    checked, known = near, sets
    for centres, name in ((3, "central"), (0, "found")):
        met = candidates(open_rows(label), checked, centres, name)
        pairs = by_fine_points(met, name)
        known = known.unionByName(sets_of(classes_of(pairs).join(known.select("class"), "class", "left_anti"), "sets"))
        label = merged(label, stage(_verified(pairs, known, percent), "rest"))
        checked = checked.unionByName(met)

    named = member.join(label.toDF("class", "c1"), "class", "left").withColumn("group", F.coalesce("c1", "class"))
    named = named.select("doc_id", "row", "n", F.when(F.col("n") > 0, F.col("group")).alias("group"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    top = [F.min(place).alias("top")] if with_rows else []
    smallest = named.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"), *top)
    out = named.join(smallest, "group", "left")
    rows = ["row", ((F.col("n") == 0) | place.eqNullSafe(F.col("top"))).alias("first")] if with_rows else []
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *rows)
