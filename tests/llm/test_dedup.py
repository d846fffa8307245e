"""Ops 2, 4 and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from kestrel.llm.components import components
from kestrel.llm.countjoin import CountTree, block_pairs, count_vector, jaccard_components, may_link, overlap_bounds, pack_point
from kestrel.llm.fmindex import FMIndex, suffix_array
from kestrel.llm.substrings import removal_digest, remove_repeats
from tests.llm.cases import documents, frame, words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removed_by_hand(width, order):
    """order: rows in document order; equal (id, text) rows are one document."""
    first, gone = {}, {}
    for key, w in order:
        gone[key] = set()
        for p in range(len(w) - width + 1):
            g = tuple(w[p: p + width])
            if g in first:
                gone[key].update(range(p, p + width))
            else:
                first[g] = key
    return gone


def check_removal(spark, rows, width, **how):
    got = removal_digest(remove_repeats(frame(spark, rows), width=width, **how)).collect()
    texts = {(i, t) for i, t, *_ in rows}
    ids = [i for i, _ in texts]
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows)
    best = None
    # rows of one id may come in either order: try both
    for flip in (False, True):
        seq = list(order)
        for i in {x for x in ids if ids.count(x) > 1}:
            at = [k for k, x in enumerate(seq) if x[0] == i]
            if flip:
                for k, v in zip(at, [seq[k] for k in reversed(at)]):
                    seq[k] = v
        gone = removed_by_hand(width, [(x, SPACED.findall(x[1] or "")) for x in seq])
        want = []
        for i, t, *_ in rows:
            w = SPACED.findall(t or "")
            keep = " ".join(x for k, x in enumerate(w) if k not in gone[i, t])
            want.append((i, len(w), len(gone[i, t]), hashlib.sha256(keep.encode()).hexdigest()))
        best = best or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert best


@pytest.mark.parametrize("how", [{}, {"hot": 0}, {"anchor": 20}, {"anchor": 3, "hot": 1}])
def test_substrings(spark, how):
    check_removal(spark, documents(), 20, **how)


def test_substrings_small_alphabet(spark):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randrange(0, 60), 3), "", "", 0) for i in rng.sample(range(1000), 40)]
    check_removal(spark, rows, 6, anchor=3)
    check_removal(spark, rows, 6, anchor=6, hot=0)
    assert remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("how", [{}, {"hot": 0}, {"anchor": 20}])
def test_substrings_repeated_rows(spark, how):
    """A row met again is no earlier place of itself, in one slice or in several."""
    rng = random.Random(12)
    own, shared = [words(rng, 70, 10**6) for _ in range(3)], words(rng, 40, 10**6)
    rows = [(1, own[0], "", "", 0)] * 2 + [(2, own[1] + " " + shared, "", "", 0)] * 3 + [(3, shared + " " + own[2], "", "", 0)] * 2 \
        + [(None, own[2][:200], "", "", 0)] * 2
    check_removal(spark, rows, 20, **how)
    for parts in (1, 7):
        got = removal_digest(remove_repeats(frame(spark, rows).repartition(parts), **how)).distinct().collect()
        assert {r["doc_id"]: r["n_removed"] > 0 for r in got} == {None: False, 1: False, 2: False, 3: True}


def test_fm_index():
    rng = np.random.default_rng(2)
    for size in (3, 5, 40):
        text = rng.integers(0, size, 400)
        order, _ = suffix_array(np.append(text, 0))
        plain = np.append(text, 0).tolist()
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        index = FMIndex(text, size, 4)
        query = rng.integers(0, size, 300)
        begin = np.array([0, 50, 52, 60, 61, 290])
        end = np.array([50, 52, 60, 61, 290, 300])
        at, lo, hi = index.matches(query, begin, end)
        low = index.earliest(lo, hi)
        want = {}
        for a, b in zip(begin, end):
            for p in range(a, b - 3):
                g = query[p: p + 4].tolist()
                if 0 not in g:
                    places = [q for q in range(len(text) - 3) if text[q: q + 4].tolist() == g]
                    if places:
                        want[p] = (len(places), places[0])
        assert {p: (h - l, e) for p, l, h, e in zip(at.tolist(), lo.tolist(), hi.tolist(), low.tolist())} == want


def shingle_set(text):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def grouped(rows, percent):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[top(i)] = top(j)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [r[0] for k, r in enumerate(rows) if top(k) == top(i) and r[0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None) if sets[i] else doc_id))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent,chunk", [(80, 2048), (50, 2)])
def test_jaccard(spark, percent, chunk):
    rng = random.Random(6)
    rows = documents()
    base = words(rng, 90).split(" ")
    passage = words(rng, 60)
    for k in range(40):  # near copies around the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(1000)}"
        rows.append((200 + rng.randrange(10**6), " ".join(w[rng.randrange(3):]), "", "", 0))
    rows += [(10**7 + k, words(rng, 12) + " " + passage, "", "", 0) for k in range(15)]  # one passage, other words
    rows += [(10**8 + k, words(rng, rng.randrange(1, 9), 4), "", "", 0) for k in range(60)]
    assert sorted(map(tuple, jaccard_components(frame(spark, rows), percent=percent, chunk=chunk).collect()), key=str) == grouped(rows, percent)


def test_jaccard_empty(spark):
    assert jaccard_components(frame(spark, [])).count() == 0


def test_count_tree():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (500, 64))
    points[100:160] = points[0] + rng.integers(0, 2, (60, 64))
    n = points.sum(1)
    tree = CountTree(points, n)
    for i in (0, 5, 120, 400):
        want = np.flatnonzero(may_link(n[i], n, np.minimum(points, points[i]).sum(1), 80))
        assert sorted(tree.search(points[i], int(n[i]), 80).tolist()) == want.tolist()


def test_block_pairs_of_all_sizes():
    """Every linking pair is found, and every pair found is over the bound."""
    rng = np.random.default_rng(4)
    sets = []
    for n in (3, 40, 300, 450, 515, 1000, 1030, 3000):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(9):
            sets.append(np.unique(np.where(rng.random(n) < rng.choice([0.02, 0.1, 0.9]), rng.integers(0, 2**63, n).astype(np.uint64), base)))
    n, points = np.array([len(x) for x in sets]), [count_vector(x) for x in sets]
    label, every = np.arange(len(sets)), np.arange(len(sets))
    linked = {(i, j) for i in every for j in every if i < j and may_link(n[i], n[j], len(np.intersect1d(sets[i], sets[j])), 80)}
    packed = [pack_point(p) for p in points]
    for left, right in ((every, every), (every[::2], every[1::2])):
        a, b = block_pairs(points, n, label, left, right, 80)
        got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        want = linked if left is right else {p for p in linked if (p[0] + p[1]) % 2}
        assert len(want) > 10 and want <= got and len(got) < 3 * len(want)
        bound = overlap_bounds([packed[x] for x, _ in got], [packed[y] for _, y in got])
        assert all(may_link(n[x], n[y], o, 80) for (x, y), o in zip(got, bound))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] \
        + [(500, 500 + k) for k in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_one_row_of_each_group(spark):
    """Groups with null or shared ids keep one row each; rows without words all stay, equal ones once."""
    import corpus_pipeline as P

    rng = random.Random(14)
    a, b, c, d = (words(rng, 80, 10**6) for _ in range(4))
    rows = [(None, a), (None, a + " x"), (None, a + " y"), (7, b), (None, b + " x"), (None, ""), (None, ""), (8, None),
            (5, c), (5, c + " x"), (5, d), (9, d + " y"), (6, c + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) == 6 and {(7, b), (None, ""), (8, None), (5, d)} <= set(got)
    assert sum(i is None and t.startswith(a) for i, t in got) == 1 and sum(i == 5 and t.startswith(c) for i, t in got) == 1


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on its own input."""
    import corpus_pipeline as P
    from kestrel.llm.queries import TOKENIZER
    from tests.llm.test_filters import contamination
    from tokenizers import Tokenizer

    rng = random.Random(9)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i in range(240) for t in [words(rng, rng.randrange(30, 90), 4000)]]
    bad = {i for i in range(0, 240, 4)}
    rows = [(i, t + " vile vile scum" if i in bad else t, *r) for i, t, *r in rows]
    rows += [(900, rows[1][1], "en", "s", 0), (901, rows[2][1] + " more", "en", "s", 0), (902, rows[3][1] + " " + rows[5][1], "en", "s", 0),
             (903, rows[7][1] + "\nend", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, rows[9][1]), (2, rows[10][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tables = [docs]
    for _, step in P.STAGES:
        tables.append(step(spark, tables[-1], str(tmp_path)).cache())
    assert all(t.columns == docs.columns for t in tables[:-1])
    seen = [sorted(map(tuple, t.collect())) for t in tables[:-1]]
    missed, lost = {r[0] for r in seen[1]} & bad, {r[0] for r in rows} - bad - {r[0] for r in seen[1]}
    assert len(missed) + len(lost) <= 6, (missed, lost)
    assert {r[0] for r in seen[2]} == {a for a, _, b in grouped(seen[1], 80) if a == b}
    gone = removed_by_hand(20, [((r[0], r[1]), SPACED.findall(r[1])) for r in seen[2]])
    for before, after in zip(seen[2], seen[3]):
        cut = gone[before[0], before[1]]
        text = " ".join(w for k, w in enumerate(SPACED.findall(before[1])) if k not in cut) if cut else before[1]
        assert after[1] == text and after[0] == before[0]
    foul = {r[0] for r in contamination([r for r in seen[3]], items) if r[5]}
    assert foul and [r[0] for r in seen[4]] == [r[0] for r in seen[3] if r[0] not in foul]
    library = Tokenizer.from_file(TOKENIZER)
    got = {r["doc_id"]: r["ids"] for r in tables[-1].collect()}
    assert got == {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in seen[4]}
    assert P.run(spark, str(tmp_path)).count() == len(got)


def test_substrings_many_equal_rows_are_linear(spark):
    """Rows equal in id and text share one list of places (each place once)."""
    text = words(random.Random(2), 100, 10**6)
    docs = frame(spark, [(None, text, "", "", 0)] * 20_000)
    got = removal_digest(remove_repeats(docs)).groupBy("n_words", "n_removed").count().collect()
    assert [tuple(r) for r in got] == [(100, 0, 20_000)]
