"""Token ids on disk as canonical length-limited Huffman codes.

Documents are put in ascending ``doc_id`` order over range partitions and tokenised; their
ids, each document closed by an end id, form one stream that is cut into blocks. Global id
counts give code lengths of at most ``max_bits`` (package-merge), and the canonical code
follows from the lengths alone, so a file set needs only those. A block is decoded without
any other: it holds its bit string, the bit offset of every ``LANE``-th id (checkpoints) and
the pieces of documents it covers. The decoder reads ``max_bits`` bits at a time through one
table and works on all lanes of a block at once.

A file set is a folder with ``code`` (id, length) and ``blocks`` (part, block, position of the
first id in the part, ids, checkpoints, bit string, document pieces), both Parquet, written
by Spark only.

Defined cases: a null text is an empty one (the end id alone); null ids come first; rows with
one ``doc_id`` are documents of their own, in the order of a digest of their texts; an empty
table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.staging import drop_staged, stage, write_cleanly, text_batches
from kestrel.llm.textarrays import runs, slices
from kestrel.llm.tokens import library_encoder, worker_encoder

BLOCK_IDS, LANE = 1 << 16, 128


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge).

    Row after row, neighbours of the row before are packed and merged with the single
    counts; how many singles stand among the items that a row hands down says which
    counts get one bit more.
    """
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    single = counts[order].astype(np.int64)
    rows, packed = [], np.empty(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate([single, packed])
        place = np.argsort(both, kind="stable")
        rows.append(place < n)
        both = both[place]
        packed = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_single in reversed(rows):
        own = int(is_single[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of (ids, lengths): by length, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(ids) else 1
        room = np.left_shift(np.int64(1), self.bits - self.lengths)
        self.code = (np.cumsum(room) - room) >> (self.bits - self.lengths)
        self.room = room

    def encoder(self) -> Callable[[np.ndarray], tuple[bytes, np.ndarray]]:
        top = int(self.ids.max()) + 1 if len(self.ids) else 1
        code, size = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.ids], size[self.ids] = self.code.astype(np.uint64), self.lengths

        def encode(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
            """Bit string of the ids, and the bit offset of every ``LANE``-th."""
            length = size[ids]
            end = np.cumsum(length)
            at = end - length
            value = code[ids] << (64 - (at & 31) - length).astype(np.uint64)
            word = at >> 5
            edge = runs(word)[:-1]
            out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
            out[word[edge]] |= np.bitwise_or.reduceat(value >> np.uint64(32), edge)
            out[word[edge] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), edge)
            return out.astype(">u4").tobytes()[: int(end[-1] + 7) >> 3], at[::LANE].astype(np.int32)

        return encode

    def decoder(self) -> Callable[[bytes, np.ndarray, int], np.ndarray]:
        symbol = np.zeros(1 << self.bits, np.int32)
        size = np.zeros(1 << self.bits, np.int64)
        full = int(self.room.sum())
        symbol[:full], size[:full] = np.repeat(self.ids, self.room), np.repeat(self.lengths, self.room)
        bits, mask = self.bits, (1 << self.bits) - 1

        def decode(payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
            """The ``n`` ids of a block, all lanes in step."""
            data = np.frombuffer(payload + bytes(4 + (LANE * bits >> 3)), np.uint8).astype(np.int64)
            window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
            at = checkpoints.astype(np.int64)
            out = np.empty((LANE, len(at)), np.int32)
            for k in range(LANE):
                look = (window[at >> 3] >> (32 - bits - (at & 7))) & mask
                out[k] = symbol[look]
                at += size[look]
                if k + 1 < LANE:  # the last lane may be short and read on into the padding
                    np.minimum(at, len(window) * 8 - 8, out=at)
            return out.T.reshape(-1)[:n]

        return decode


def _blocks(path: str, end_id: int):
    """Sorted documents of a partition to blocks of ids with the document pieces they cover.

    The last row, of block -1, has the partition's ids and their counts in ``doc_no`` and ``piece_at``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = worker_encoder(library_encoder, path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        pieces: list[tuple] = []  # (doc_id, number of the document in the part, offset in it, ids), arrays
        size = block = number = 0
        total = np.zeros(0, np.int64)
        kind = pa.int64()

        def row(block_: int, n: int, ids: np.ndarray, names: pa.Array, no, offset, count) -> pa.RecordBatch:
            lists = [names, pa.array(no, pa.int64()), pa.array(offset, pa.int64()), pa.array(count, pa.int32())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([block_]), pa.array([max(block_, 0) * BLOCK_IDS]), pa.array([n], pa.int32()),
                 pa.array([ids.itemsize], pa.int32()), pa.array([ids.tobytes()], pa.binary()), *lists],
                names=["part", "block", "position", "n_ids", "width", "ids", "doc_id", "doc_no", "piece_at", "piece_n"])

        def flush() -> pa.RecordBatch:
            nonlocal total
            ids = np.concatenate(held).astype(np.uint32)
            seen = np.bincount(ids, minlength=len(total))
            seen[: len(total)] += total
            total = seen
            names, no, offset, n = zip(*pieces)
            return row(block, len(ids), ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4"),
                       pa.concat_arrays(names), *map(np.concatenate, (no, offset, n)))

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for rows, texts in slices(batch, "text"):
                plain, off = encode(texts)
                begin = off + np.arange(len(off))  # of each document once every one has its end id
                ids = np.full(int(begin[-1]), end_id, np.uint32)
                inside = np.ones(len(ids), bool)
                inside[begin[1:] - 1] = False
                ids[inside] = plain
                cuts = np.arange(BLOCK_IDS - size, len(ids), BLOCK_IDS)
                start = np.union1d(begin[:-1], cuts)
                doc = np.searchsorted(begin, start, side="right") - 1
                count = np.diff(np.append(start, len(ids)))
                names = rows.column(0)
                edge, done = np.searchsorted(start, np.append(cuts, len(ids))).tolist(), 0
                for a, b, to in zip([0, *edge], edge, [*cuts.tolist(), len(ids)]):
                    if b > a:
                        held.append(ids[done:to])
                        pieces.append((names.take(pa.array(doc[a:b])), number + doc[a:b], start[a:b] - begin[doc[a:b]], count[a:b]))
                        size, done = size + to - done, to
                    if size == BLOCK_IDS:
                        yield flush()
                        block, size, held, pieces = block + 1, 0, [], []
                number += len(texts)
        if size:
            yield flush()
        seen = np.flatnonzero(total)
        yield row(-1, 0, np.empty(0, "<u2"), pa.array([], kind), seen, total[seen], [])

    return run


_BLOCK_KEYS = "part long, block long, position long, n_ids int"


def _piece_keys(kind: str) -> str:
    return f"doc_id array<{kind}>, doc_no array<long>, piece_at array<long>, piece_n array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                    end_id: int = 2, max_bits: int = 20) -> None:
    """Tokenise every whole text and write the file set into folder ``path``."""
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", F.xxhash64("text")]
    plain = stage(source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _blocks(tokenizer, end_id), f"{_BLOCK_KEYS}, width int, ids binary, {_piece_keys(kind)}"), "ids")
    tally = F.arrays_zip(F.col("doc_no").alias("id"), F.col("piece_at").alias("n"))
    counts = plain.filter("block < 0").select(F.inline(tally)).groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.orderBy("id").collect()  # bounded by the vocabulary
    ids = np.array([r["id"] for r in found], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in found], np.int64), max_bits) if found else np.empty(0, np.int64)
    spark = docs.sparkSession
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist())), "id long, length long") \
        .coalesce(1).write.parquet(f"{path}/code")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Code(ids, lengths).encoder()
        for batch in batches:
            at = batch.schema.get_field_index
            done = [encode(np.frombuffer(raw.as_buffer(), f"<u{w}").astype(np.int64))
                    for w, raw in zip(batch.column(at("width")).to_pylist(), batch.column(at("ids")))]
            columns = [batch.column(at(n)) for n in ("part", "block", "position", "n_ids")]
            columns += [pa.array([c for _, c in done], pa.list_(pa.int32())), pa.array([p for p, _ in done], pa.binary())]
            columns += [batch.column(at(n)) for n in ("doc_id", "doc_no", "piece_at", "piece_n")]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "position", "n_ids", "checkpoints", "bits",
                                                             "doc_id", "doc_no", "piece_at", "piece_n"])

    packed = plain.filter("block >= 0").mapInArrow(pack, f"{_BLOCK_KEYS}, checkpoints array<int>, bits binary, {_piece_keys(kind)}")
    write_cleanly(packed, f"{path}/blocks", "lz4_raw")
    drop_staged(plain)


def read_code(spark: SparkSession, path: str) -> Code:
    rows = spark.read.parquet(f"{path}/code").collect()  # bounded by the vocabulary
    return Code(np.array([r["id"] for r in rows], np.int64), np.array([r["length"] for r in rows], np.int64))


def read_token_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode every block by itself: one row per document piece.

    Returns (part, doc_no, doc_id, piece_at, position, n, crc32) and, if asked, the ``ids``.
    ``position`` counts from the part's first id; the digest is over little-endian unsigned
    32-bit integers.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    code = read_code(spark, path)
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = code.decoder()
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for b in range(len(batch)):
                ids = decode(column["bits"][b].as_py(), np.asarray(column["checkpoints"][b].values),
                             column["n_ids"][b].as_py()).astype("<u4")
                sizes = np.asarray(column["piece_n"][b].values, np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]
                rows = [pa.array(np.full(len(sizes), column["part"][b].as_py())), column["doc_no"][b].values,
                        column["doc_id"][b].values, column["piece_at"][b].values,
                        pa.array(begins + column["position"][b].as_py()), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["part", "doc_no", "doc_id", "piece_at", "position", "n", "crc32"]
                if with_ids:
                    rows.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                                         pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(rows, names=names)

    return blocks.mapInArrow(unpack, f"part long, doc_no long, doc_id {kind}, piece_at long, position long, n long, "
                                     "crc32 long" + ", ids array<int>" * with_ids)


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial (reflected bits)."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


_SHIFT = [0x00800000]  # x**8, and its squares: moving a CRC over 1, 2, 4, ... bytes
while len(_SHIFT) < 64:
    _SHIFT.append(_times(_SHIFT[-1], _SHIFT[-1]))


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes end to end, from the (CRC-32, number of bytes) of their pieces."""
    total = 0
    for crc, size in pieces:
        k = 0
        while size >> k:
            if size >> k & 1:
                total = _times(_SHIFT[k], total)
            k += 1
        total ^= crc
    return total


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column(3)
        off = pieces.offsets.to_numpy()
        crc = pieces.values.field("crc32").to_numpy()[off[:-1]]  # of a document that lies in one block
        for i in np.flatnonzero(np.diff(off) > 1).tolist():
            crc[i] = joined_crc([(x["crc32"], 4 * x["n"]) for x in sorted(pieces[i].as_py(), key=lambda x: x["piece_at"])])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    base = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    whole = read_token_pieces(spark, path, with_ids=False).groupBy("part", "doc_no").agg(
        F.min("doc_id").alias("doc_id"), F.min("position").alias("position"), F.sum("n").alias("n_tokens"),
        F.collect_list(F.struct("piece_at", "n", "crc32")).alias("pieces"))
    kind = whole.schema["doc_id"].dataType.simpleString()
    return whole.join(base, "part").select("doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "pieces") \
        .mapInArrow(_join_pieces, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
