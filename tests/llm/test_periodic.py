"""Op 13 against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from kestrel.llm.periodic import find_runs, periodic_runs, repeat_tails, run_digest, smaller_neighbours
from tests.llm.cases import documents, frame, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(w, least, times):
    out = set()
    for q in range(1, len(w) // times + 1):
        x = 0
        while x + q < len(w):
            s = x
            while x + q < len(w) and w[x] == w[x + q]:
                x += 1
            size = x + q - s
            if x > s and size >= max(least, times * q) and not any(w[s: s + size - r] == w[s + r: s + size] for r in range(1, q)):
                out.add((s, size, q))
            x += x == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.choice([0, 1, 5, 10, 40, 90, 150]), rng.choice([1, 2, 3, 8])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.6 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        least, times = rng.choice([(24, 3), (6, 3), (2, 2), (8, 2), (3, 3)])
        first = np.append(0, np.cumsum([len(d) for d in docs]))
        start, end, period = find_runs(np.array(sum(docs, []), dtype=np.int64), first, least, times)
        want = [(s + int(f), s + n + int(f), q) for d, f in zip(docs, first) for s, n, q in runs_by_hand(d, least, times)]
        assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_neighbours_by_jumps_and_by_scan():
    rng = random.Random(2)
    for inner in [[], list(range(90)), list(range(90, 0, -1)), [3] * 70] + [[rng.randrange(9) for _ in range(80)] for _ in range(20)]:
        v = np.array([-1, *inner, -1])
        for patience in (0, 48):
            low, high = smaller_neighbours(v, patience)
            for k in range(1, len(v) - 1):
                assert low[k] == max(j for j in range(k) if v[j] < v[k])
                assert high[k] == min(j for j in range(k + 1, len(v)) if v[j] < v[k])


def digest_by_hand(doc_id, w):
    found = runs_by_hand(w, 24, 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def tail_by_hand(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark):
    rng = random.Random(9)
    rows = documents() + [(100 + i, " ".join((["ab", "c"] * 30)[: 24 + i % 9] + [words(rng, 90)]), "", "", 0) for i in range(60)]
    got = run_digest(periodic_runs(repeat_tails(frame(spark, rows)))).collect()
    want = [digest_by_hand(i, tail_by_hand(i, SPACED.findall(t or ""))) for i, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 30
    assert run_digest(periodic_runs(frame(spark, []))).count() == 0


def test_passes_rows_on(spark):
    done = periodic_runs(frame(spark).repartition(3))
    assert done.select("whole.*").columns == frame(spark).columns
    assert done.filter("doc_id IS NULL" if "doc_id" in done.columns else "whole.doc_id IS NULL").count() == 2
