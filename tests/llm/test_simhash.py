"""Op 12 against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kestrel.llm.simhash import _cells, close_links, close_pairs, simhash_components, simhashes, spanning_forest
from kestrel.llm.textarrays import texts_of
from tests.llm.cases import documents, frame, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def print_by_hand(text):
    w = SPACED.findall((text or "").translate(LOW))
    if not w:
        return 0
    pieces = [" ".join(w[i: i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_fingerprints():
    rng = random.Random(1)
    texts = [None] + ["".join(rng.choice([" ", "\n", "  "]) + "".join(rng.choice("abAé日Z") for _ in range(rng.choice([1, 3, 7, 9, 14, 40])))
                              for _ in range(rng.choice([0, 1, 2, 3, 4, 20, 200]))) for _ in range(200)]
    texts.append(" ".join(f"w{rng.randrange(9)}" for _ in range(300_000)))  # longer than a step of votes
    assert simhashes(texts_of(pa.array(texts, pa.string())), 3, 42).tolist() == [print_by_hand(t) for t in texts]


def parts_by_hand(prints):
    """Smallest index reachable from each by at most three differing bits."""
    low = list(range(len(prints)))
    close = [[j for j, y in enumerate(prints) if (x ^ y).bit_count() <= 3] for x in prints]
    moved = True
    while moved:
        new = [min(low[j] for j in near) for near in close]
        moved, low = new != low, new
    return low


def clustered(seed, n):
    """Fingerprints in chains, balls and alone."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(2 * n):
        x = rng.choice(out[n // 2:])
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_pairs_of_a_cell():
    x = np.array(clustered(4, 300), np.uint64)
    for other in (x, x[::3], np.empty(0, np.uint64)):
        got = set()
        for a, b in close_pairs(x, other, x[:16], 3):
            got |= set(zip(a.tolist(), b.tolist()))
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(x[:, None] ^ other[None]) <= 3))))


def test_close_pairs_meet_in_a_cell():
    x = np.unique(np.array(clustered(5, 200), np.uint64))
    where = {}
    for batch in _cells(x[:40], 3)(iter([pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["print"])])):
        for cell, home, p in zip(*(c.to_pylist() for c in batch.columns)):
            where.setdefault(p, {})[cell] = home
    assert all(sum(cells.values()) == 1 for cells in where.values())
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    for p, q in zip(x[a].view(np.int64).tolist(), x[b].view(np.int64).tolist()):
        assert any(where[p][c] or where[q][c] for c in where[p].keys() & where[q].keys())


def test_spanning_forest():
    rng = random.Random(3)
    a, b = (np.array([rng.randrange(60) for _ in range(50)]) for _ in range(2))
    x, y = spanning_forest(a, b)

    def parts(links):
        low = list(range(60))
        for _ in range(60):
            for p, q in links:
                low[p] = low[q] = min(low[p], low[q])
        return low
    assert parts(list(zip(x, y))) == parts(list(zip(a, b)))
    assert len(x) == 60 - len(set(parts(list(zip(a, b)))))


@pytest.mark.parametrize("chunk", [1 << 15, 50])
def test_links_join_what_brute_force_joins(spark, chunk):
    prints = sorted(set(clustered(7, 250)))
    low = parts_by_hand(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = close_links(spark.createDataFrame([(p,) for p in signed], "print long"), len(signed), 3, 1 << 14, chunk).collect()
    at = {p: i for i, p in enumerate(signed)}
    got = list(range(len(signed)))
    for _ in range(len(signed)):
        before = list(got)
        for r in links:
            got[at[r.a]] = got[at[r.b]] = min(got[at[r.a]], got[at[r.b]])
        if got == before:
            break
    assert got == low


def test_query_against_brute_force(spark):
    rng = random.Random(8)
    base = [words(rng, 120) for _ in range(6)]
    rows = documents() + [(200 + i, base[i % 6] + (f" x{i}" if i % 3 else ""), "", "", 0) for i in range(60)] + [(None, "alone in id", "", "", 0)]
    got = simhash_components(frame(spark, rows)).collect()
    prints = [print_by_hand(t) for _, t, *_ in rows]
    low = parts_by_hand(prints)
    name = {}
    for (i, *_), part in zip(rows, low):
        name[part] = min(x for x in (name.get(part), i) if x is not None) if i is not None or name.get(part) is not None else None
    want = [(i, f"{p:016x}", name[part]) for (i, *_), p, part in zip(rows, prints, low)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash_components(frame(spark, [])).count() == 0


def test_many_copies_are_one_class(spark):
    rows = [(i, "one and the same text of a few words", "", "", 0) for i in range(5000)] + [(None, "one and the same text of a few words", "", "", 0)] * 3
    got = simhash_components(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 5003
