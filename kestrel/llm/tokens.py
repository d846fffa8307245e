"""Whole texts to token ids, encoding every distinct chunk of text once.

A byte-level tokenizer splits before a white-space character that a visible character
follows, and between a letter and a comma, full stop and the like, so a text can be cut there
into chunks ("` word`", "`,`") whose ids do not depend on their neighbours. Chunks are told apart inside a slice by a 64-bit digest and kept by
their bytes in a bounded table per worker; only chunks not in it go to the tokenizer.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import repeat

import numpy as np

from kestrel.llm.textarrays import Texts, distinct, ragged, span_digests

Encode = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: bytes that surely begin a visible character (not a control, not the lead byte of a wide blank)
_VISIBLE = (np.arange(256) > 0x20) & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_STOP = np.isin(np.arange(256), list(b",.;:!?()"))


def stop_but(special: list[str]) -> np.ndarray:
    """Bytes of marks that end a word of letters and stand in no special token."""
    return _STOP & ~np.isin(np.arange(256), list("".join(special).encode()))


def visible_but(special: list[str]) -> np.ndarray:
    """Bytes that surely begin a visible character and no special token."""
    return _VISIBLE & ~np.isin(np.arange(256), [s.encode()[0] for s in special if s])


def chunk_starts(texts: Texts, visible: np.ndarray = _VISIBLE, stop: np.ndarray = _STOP) -> np.ndarray:
    """Starts of the chunks: text starts, blanks before a visible character of the same text, marks after a letter."""
    data, off = texts.data, texts.off
    cut = np.zeros(len(data), bool)
    cut[:-1] = _BLANK[data[:-1]] & visible[data[1:]]
    begin = off[:-1][np.diff(off) > 0]
    cut[begin[begin > 0] - 1] = False  # the next visible character is in the next text
    cut[1:] |= _LETTER[data[:-1]] & stop[data[1:]]
    cut[begin] = True
    return np.flatnonzero(cut)


#: Memory of a chunk in the table beside its bytes and ids: the key object, its slot and its number.
ENTRY_BYTES = 160


class ChunkEncoder:
    """Ids of whole texts; ``encode`` gives (ids end to end, ids per chunk), ``most`` bounds the table's bytes."""

    def __init__(self, encode: Encode, special: list[str], most: int = 96 << 20):
        self.encode, self.most, self.visible, self.stop = encode, most, visible_but(special), stop_but(special)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)
        self.used = self.held = 0

    def _learn(self, chunks: list[bytes]) -> None:
        ids, sizes = self.encode(chunks)
        n, total = len(self.place), len(ids)
        if len(self.begin) < n + len(chunks) + 1:
            self.begin = np.append(self.begin, np.zeros(max(len(self.begin), len(chunks)) + 1, np.int64))
        if len(self.ids) < self.used + total:
            self.ids = np.append(self.ids, np.zeros(max(len(self.ids), total), np.uint32))
        self.begin[n + 1: n + len(chunks) + 1] = self.used + np.cumsum(sizes)
        self.ids[self.used: self.used + total] = ids
        self.used += total
        self.held += sum(map(len, chunks)) + ENTRY_BYTES * len(chunks) + 4 * total
        self.place.update(zip(chunks, range(n, n + len(chunks))))

    def __call__(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts in them)."""
        starts = chunk_starts(texts, self.visible, self.stop)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(texts.data))
        sample, which = distinct(span_digests(texts, starts, ends))
        raw = texts.data.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
        if self.held > self.most:
            self._clear()
        entry = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(entry < 0)  # every key is there once
        entry[new] = np.arange(len(self.place), len(self.place) + len(new))
        self._learn([keys[i] for i in new.tolist()])
        size = (self.begin[entry + 1] - self.begin[entry])[which]
        ids = self.ids[ragged(self.begin[entry][which], size)]
        total = np.append(0, np.cumsum(size))
        return ids, total[np.searchsorted(starts, texts.off)]


def library_encoder(path: str) -> Callable[[Texts], tuple[np.ndarray, np.ndarray]]:
    """The tokenizers library's ids (no special tokens added, no truncation or padding).

    A byte-level tokenizer is used by chunks, any other on each whole text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    spec = json.loads(tok.to_str())
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    by_chunk = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
        and not pre.get("add_prefix_space") \
        and not any(a["lstrip"] or a["rstrip"] or any(c.isspace() for c in a["content"]) for a in added)

    def plain(texts: list[bytes]) -> list[np.ndarray]:
        got = tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    if not by_chunk:
        def whole(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
            found = plain([texts.raw(i) for i in range(len(texts))])
            off = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
            return (np.concatenate(found) if found else np.empty(0, np.uint32)), off
        return whole

    width = np.zeros(tok.get_vocab_size(with_added_tokens=True) + 1, np.int64)
    for token, i in spec["model"]["vocab"].items():
        width[i] = len(token)  # one character stands for one byte
    for a in added:
        width[a["id"]] = len(a["content"].encode())

    special = [a["content"] for a in added]
    visible = visible_but(special)

    def chunks(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with a blank go through the library some thousand bytes at a time."""
        if not parts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        raw = b"".join(parts)
        data = np.frombuffer(raw + b"\0", np.uint8)
        want = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        start = np.append(0, want[:-1])
        joins = (want - start > 1) & _BLANK[data[start]] & visible[data[start + 1]]
        cut = start[~joins | np.append(True, np.diff(start // 8192) > 0)].tolist()
        ids = plain([raw[a:b] for a, b in zip(cut, [*cut[1:], len(raw)])])
        ids = np.concatenate(ids)
        reach = np.cumsum(width[ids])
        upto = np.searchsorted(reach, want, side="right")
        if not (upto[-1] == len(ids) and np.array_equal(reach[upto - 1], want)):
            raise ValueError(f"{path}: its tokens do not cover a text byte by byte")
        return ids, np.diff(upto, prepend=0)

    return ChunkEncoder(chunks, special)


_ENCODERS: dict[tuple, Callable[[Texts], tuple[np.ndarray, np.ndarray]]] = {}


def worker_encoder(make: Callable[[str], Callable], path: str) -> Callable[[Texts], tuple[np.ndarray, np.ndarray]]:
    """One encoder per Python worker; its table outlives the task."""
    key = (make.__module__, make.__qualname__, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = make(path)
    return _ENCODERS[key]
