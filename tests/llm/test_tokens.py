"""Ops 1, 3 and 6: exact round trips and comparison with the tokenizers library."""

import hashlib
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kestrel.llm.bpe import Vocabulary, bpe_decode, bpe_encode, bpe_round_trip
from kestrel.llm.huffman import Code, code_lengths, joined_crc, read_token_pieces, token_index, write_token_ids
from kestrel.llm.lengths import length_histogram, length_quantiles, token_lengths, truncated_total
from tests.llm.cases import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    return [library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]


def test_code_lengths_optimal_and_limited():
    rng = np.random.default_rng(0)
    for n, bits in ((1, 4), (2, 4), (5, 3), (200, 8), (300, 20)):
        counts = (rng.pareto(1.0, n) * 10).astype(np.int64) + 1
        lengths = code_lengths(counts, bits)
        assert lengths.max() <= bits and (n == 1 or (2.0 ** -lengths).sum() == 1)
    assert code_lengths(np.array([1, 1, 2, 4]), 8).tolist() == [3, 3, 2, 1]
    with pytest.raises(ValueError):
        code_lengths(np.ones(9, np.int64), 3)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 5000), 900)
    seen, counts = np.unique(ids, return_counts=True)
    code = Code(seen, code_lengths(counts, 14))
    encode, decode = code.encoder(), code.decoder()
    for n in (1, 127, 128, 129, 5000):
        assert np.array_equal(decode(*encode(ids[:n]), n), ids[:n])


def test_joined_crc():
    data = bytes(random.Random(0).randrange(256) for _ in range(1000))
    cut = [0, 4, 400, 404, 1000]
    assert joined_crc([(zlib.crc32(data[a:b]), b - a) for a, b in zip(cut, cut[1:])]) == zlib.crc32(data)


def test_file_set(spark, library):
    rows = documents()
    path = tempfile.mkdtemp(prefix="kestrel-test-") + "/set"
    write_token_ids(frame(spark, rows).repartition(3), path, PATH)
    got = sorted(token_index(spark, path).collect(), key=lambda r: r["start"])
    want = sorted((r[0] is not None, r[0], zlib.crc32(np.array(i + [2], "<u4").tobytes()), len(i) + 1)
                  for r, i in zip(rows, expected(library, rows)) if r[0] is not None)
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == [w[1] for w in want]
    assert sorted((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got if r["doc_id"] is not None) == [w[1:] for w in want]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got][:2] == [None, None]
    pieces = {(r["doc_id"], r["piece_at"]): r["ids"] for r in read_token_pieces(spark, path).collect() if r["doc_id"] == 17}
    assert [x for k in sorted(pieces) for x in pieces[k]] == expected(library, [r for r in rows if r[0] == 17])[0] + [2]


def test_file_set_empty(spark):
    path = tempfile.mkdtemp(prefix="kestrel-test-") + "/set"
    write_token_ids(frame(spark, []), path, PATH)
    assert token_index(spark, path).count() == 0


def test_documents_over_many_blocks(spark, library, monkeypatch):
    text = " ".join(f"word{i * 7919 % 1009}" for i in range(60000))
    path = tempfile.mkdtemp(prefix="kestrel-test-") + "/set"
    write_token_ids(frame(spark, [(1, "a", None, None, 1), (2, text, None, None, 1), (3, None, None, None, 1)]), path, PATH)
    ids = library.encode(text, add_special_tokens=False).ids + [2]
    assert len(ids) > 2 * 65536
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_index(spark, path).collect()}
    assert got[2] == (2, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and got[3][:2] == (2 + len(ids), 1)


def test_round_trip(spark, library):
    rows = documents()
    got = sorted(map(tuple, bpe_round_trip(frame(spark, rows), PATH).collect()), key=str)
    want = sorted(((r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest())
                   for r, i in zip(rows, expected(library, rows))), key=str)
    assert got == want
    back = bpe_decode(bpe_encode(frame(spark, rows), PATH), PATH)
    assert sorted((r["text"] for r in back.collect())) == sorted((t or "") for _, t, *_ in rows)
    assert bpe_round_trip(frame(spark, []), PATH).count() == 0


def test_backtracking_equals_merging(library):
    rng = random.Random(5)
    vocab = Vocabulary(PATH)
    letters = ["a", "b", "th", "é", "日", "ing", "🙂", "zz", "x"]
    for _ in range(1500):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        if word.isalpha():
            assert vocab.encode_word(word.encode()) == library.encode(word, add_special_tokens=False).ids


def test_length_histogram(spark, library):
    rows = documents()
    sizes = sorted(map(len, expected(library, rows)))
    histogram = length_histogram(token_lengths(frame(spark, rows), PATH)).cache()
    for r in histogram.collect():
        n = r["n_tokens"]
        assert (r["n_docs"], r["docs_ge"]) == (sizes.count(n), sum(s >= n for s in sizes))
        assert r["tokens_ge"] == sum(s for s in sizes if s >= n) and r["total_tokens"] == sum(sizes)
        assert r["truncated_tokens"] == sum(min(s, n) for s in sizes)
        assert r["share_le"] == sum(s <= n for s in sizes) / len(sizes)
    got = {r["limit"]: (r["n_tokens_kept"], r["docs_cut"]) for r in truncated_total(histogram, [0, 3, 100, 10**6]).collect()}
    assert got == {x: (sum(min(s, x) for s in sizes), sum(s > x for s in sizes)) for x in (0, 3, 100, 10**6)}
    q = {r["share"]: r["n_tokens"] for r in length_quantiles(histogram, [0.5, 1.0]).collect()}
    assert q == {0.5: sizes[(len(sizes) + 1) // 2 - 1], 1.0: sizes[-1]}
    assert length_histogram(token_lengths(frame(spark, []), PATH)).count() == 0


def test_given_batch_settings_are_kept(spark):
    from kestrel.llm.staging import text_batches
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        text_batches(spark.range(1))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
