"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton gives the longest token that starts at each byte of a word. The
encoder takes them greedily and keeps a choice only if the pair-compatibility table says
that merging by rank would leave a border between the two tokens; otherwise it tries the
next shorter token, and then steps back. No position is refused twice, so the work is linear
in the word and the tokens are exactly those of the merge procedure. Decoding gathers token
bytes from one array through an offset table.

Defined cases: a null text is an empty one (no tokens, decodes to the empty text); special
tokens in a text become their ids, as the tokenizer's own library does; repeated rows get
equal results each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import text_batches, tidied
from kestrel.llm.textarrays import ragged, slices
from kestrel.llm.tokens import ChunkEncoder, worker_encoder

#: Fixed value: the byte-level split into words before merging.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 for
    itself, the other bytes for the letters from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, the two parts of each, and the tables of the encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = (model["vocab"][x] for x in (m if isinstance(m, list) else m.split(" ")))
            whole = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.rank[left, right] = r
            self.parts.setdefault(whole, (left, right))
        self.made_at = {t: self.rank[p] for t, p in self.parts.items()}  # rank at which a token comes to be
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.automaton = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self._shorter: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}

    def shorter(self, token: int) -> tuple[int, int] | None:
        """The longest token that is a proper beginning of ``token``, and its size."""
        if token not in self._shorter:
            b = self.bytes_of[token]
            self._shorter[token] = next(((self.id_of[b[:n]], n) for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), None)
        return self._shorter[token]

    def fits(self, left: int, right: int) -> bool:
        """Pair-compatibility table: does merging by rank leave the border left | right alone?

        Both tokens are taken apart again from the last merge backwards; the border falls if
        the two pieces that face each other had a merge that comes before the merge that
        would carry either of them further.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            known = True
            top = 1 << 60  # rank of the earliest merge that takes away a piece at the border
            right_top = False  # ... and whether it is one on the right, where the left merges first on a tie
            a, b = left, right
            while True:
                r = self.rank.get((a, b))
                if r is not None and (r < top or (r == top and right_top)):
                    known = False
                    break
                ra, rb = self.made_at.get(a, -1), self.made_at.get(b, -1)
                if ra < 0 and rb < 0:
                    break
                if ra > rb:
                    top, right_top, a = ra, False, self.parts[a][1]
                else:
                    top, right_top, b = rb, True, self.parts[b][0]
            if len(self._fits) > 250_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one word."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        text = word.decode("latin-1")
        n = len(text)
        longest_from, fits, shorter, known = self.automaton.iter_long, self.fits, self.shorter, self._fits
        refused: set[int] = set()  # borders that no encoding of the beginning reaches
        out: list[tuple[int, int]] = []
        at, last = 0, -1
        ahead, straight = longest_from(text), True  # straight: ``ahead`` has just given the token that is tried
        token, size = next(ahead)[1]
        while True:
            if at + size not in refused and (last < 0 or (
                    ok if (ok := known.get(last << 32 | token)) is not None else fits(last, token))):
                out.append((token, size))
                at, last = at + size, token
                if at == n:
                    return [t for t, _ in out]
                if not straight:
                    ahead, straight = longest_from(text, at), True
                token, size = next(ahead)[1]
                continue
            straight = False
            less = shorter(token)
            while less is None:  # no token can follow: step back and take a shorter one there
                refused.add(at)
                token, size = out.pop()
                at -= size
                last = out[-1][0] if out else -1
                less = shorter(token)
            token, size = less


_VOCABULARIES: dict[str, Vocabulary] = {}


def worker_vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker, for its encoder and its decoder."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def backtracking_encoder(path: str) -> ChunkEncoder:
    """Encoder of whole texts over the vocabulary file at ``path``."""
    vocab, split = worker_vocabulary(path), regex.compile(WORD)
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") \
        if vocab.special else None
    known: dict[str, list[int]] = {}
    before: dict[str, list[int]] = {}  # words not met since ``known`` was last empty

    def one(chunk: str) -> list[int]:
        nonlocal known, before
        if chunk in known:  # a word by itself
            return known[chunk]
        out: list[int] = []
        for word in split.findall(chunk):
            ids = known.get(word)
            if ids is None:
                if len(known) > 60_000:
                    known, before = {}, known
                ids = before.get(word)
                known[word] = ids = vocab.encode_word(word.encode()) if ids is None else ids
            out += ids
        return out

    def chunks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found: list[int] = []
        sizes = []
        for raw in parts:
            text = raw.decode()
            if cut is not None and cut.search(text):
                ids = [t for piece in cut.split(text) for t in
                       ([vocab.special[piece]] if piece in vocab.special else one(piece))]
            else:
                ids = one(text)
            found += ids
            sizes.append(len(ids))
        return np.array(found, np.uint32), np.array(sizes, np.int64)

    return ChunkEncoder(chunks, list(vocab.special), most=64 << 20)


class OffsetDecoder:
    """Bytes of all tokens end to end, with the offset of each id."""

    def __init__(self, path: str):
        vocab = worker_vocabulary(path)
        names = vocab.bytes_of | {i: t.encode() for t, i in vocab.special.items()}
        self.size = np.zeros(max(names) + 1, np.int64)
        for i, b in names.items():
            self.size[i] = len(b)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(names.get(i, b"") for i in range(len(self.size))), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids end to end, end of each id in them)."""
        size = self.size[ids]
        return self.data[ragged(self.begin[ids], size)], np.cumsum(size)


_DECODERS: dict[str, OffsetDecoder] = {}


def worker_decoder(path: str) -> OffsetDecoder:
    if path not in _DECODERS:
        _DECODERS[path] = OffsetDecoder(path)
    return _DECODERS[path]


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text as token ids."""
    source = _source(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(backtracking_encoder, path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids, off = encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): texts of id lists; bytes that are no UTF-8 become replacement characters."""
    source = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = worker_decoder(path)
        for batch in batches:
            out = []
            for x in batch.column(1):
                values = np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) if x.is_valid else np.empty(0, np.int64)
                out.append(decode(values)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """Encode, then decode what was encoded, in one pass.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256) and, if asked, ``ids``; the ids are
    digested as little-endian unsigned 32-bit integers, the decoded text as UTF-8.
    """
    source = _source(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = worker_encoder(backtracking_encoder, path), worker_decoder(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                ids, off = encode(texts)
                data, ends = decode(ids)
                reach = np.append(0, ends)[off]
                wire = ids.astype("<u4")
                seen, back = [], []
                for i in range(len(texts)):
                    seen.append(hashlib.sha256(wire[off[i]: off[i + 1]]).hexdigest())
                    body = data[reach[i]: reach[i + 1]].tobytes().decode("utf-8", "replace")
                    back.append(hashlib.sha256(body.encode()).hexdigest())
                columns = [part.column(0), pa.array(np.diff(off)), pa.array(seen), pa.array(back)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidied(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                             + ", ids array<int>" * with_ids)
