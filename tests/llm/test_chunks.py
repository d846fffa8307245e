"""Chunks of the encoders, and their ids beside the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kestrel.llm.bpe import backtracking_encoder
from kestrel.llm.textarrays import Texts
from kestrel.llm.tokens import ChunkEncoder, library_encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_word_and_mark_are_chunks_of_their_own():
    """A word is tokenised once, whatever mark follows it; nothing is cut inside a special token."""
    got = []

    def encode(parts):
        got.extend(parts)
        return np.arange(len(parts), dtype=np.uint32), np.ones(len(parts), np.int64)

    def texts(*raw):
        return Texts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64))

    ChunkEncoder(encode, [])(texts(b"a word, a word. A word; it's", b"word!"))
    assert sorted(got) == sorted([b"a", b" word", b",", b" a", b".", b" A", b";", b" it's", b"word", b"!"])
    got.clear()
    ChunkEncoder(encode, ["<x,y>"])(texts(b"in <x,y> it, so."))
    assert sorted(got) == sorted([b"in <x,y>", b" it,", b" so", b"."])


def test_encoders_equal_the_library_at_marks_and_special_tokens():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    pieces = ["a", "it", "'s", "'", " ", ".", ",", "(", ")", "!?", ":", "\n", "  ", "é", "日", *list(tok.get_added_tokens_decoder().values())[:1], "1", "aetherially"]
    rows = ["".join(str(getattr(p, "content", p)) for p in rng.choices(pieces, k=rng.randrange(40))) for _ in range(500)]
    raw = [r.encode() for r in rows]
    off = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    want = [tok.encode(r, add_special_tokens=False).ids for r in rows]
    for make in (backtracking_encoder, library_encoder):
        ids, at = make(PATH)(Texts(np.frombuffer(b"".join(raw), np.uint8), off))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
