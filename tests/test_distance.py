"""String measures: native expressions agree with the per-pair helpers; properties."""

import itertools

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from kestrel.functions import distance as D
from kestrel.operators import matching as M

WORDS = ["kitten", "sitting", "ca", "abc", "martha", "marhta", "dixon", "dicksonx", "", "a", "same", "same"]


def test_known_values():
    assert D.py_levenshtein("kitten", "sitting") == 3
    assert D.py_damerau("ca", "abc") == 2
    assert D.py_hamming("abc", "abd") == 1 and D.py_hamming("abc", "a") == 2
    assert abs(D.py_jaro("martha", "marhta") - 0.9444444444) < 1e-9
    assert abs(D.py_jaro("martha", "marhta", True) - 0.9611111111) < 1e-9
    assert D.py_token("Jaccard", "aab", "ab") == 2 / 3
    assert D.py_needleman_wunsch("ab", "ab") == 2.0
    assert D.py_smith_waterman("xab", "ab") == 2.0


def test_against_duckdb():
    con = duckdb.connect()
    for a, b in itertools.product(WORDS, WORDS):
        if not a or not b:
            continue
        assert D.py_levenshtein(a, b) == con.execute("select levenshtein(?, ?)", [a, b]).fetchone()[0]
        assert D.py_damerau(a, b) == con.execute("select damerau_levenshtein(?, ?)", [a, b]).fetchone()[0]
        if a != b:
            jw = con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
            assert abs(D.py_jaro(a, b, True) - jw) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", max_size=8), st.text(alphabet="abcd", max_size=8))
def test_symmetry_and_ranges(a, b):
    for name in ("Levenshtein", "DamerauLevenshtein", "Hamming"):
        assert D.py_measure(name, a, b) == D.py_measure(name, b, a)
    for name in D.TOKEN + ("Jaro",):
        v = D.py_measure(name, a, b)
        assert 0.0 <= v <= 1.0


def test_native_matches_python(spark):
    inputs = spark.createDataFrame([(w,) for w in set(WORDS) if w], "k string")
    for algo in ("Levenshtein", "Hamming", "Jaccard", "Overlap", "Cosine", "Sorensen", "JaroWinkler"):
        got = M.textdist_match(inputs, inputs, "k", "k", algo, 1, 3, block_size=4).collect()
        terms = sorted(set(w for w in WORDS if w))
        desc = algo in D.REVERSE
        for r in got:
            scores = sorted(((round(D.py_measure(algo, r.input, t), 4), t) for t in terms),
                            key=lambda x: ((-x[0]) if desc else x[0], x[1]))
            assert (r.match, r.score) == (scores[r.rank - 1][1], scores[r.rank - 1][0])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcde", max_size=9), st.lists(st.text(alphabet="abcde", max_size=9), min_size=1, max_size=6),
       st.sampled_from([1, 2]))
def test_block_dp_equals_pairwise(a, terms, q):
    for name in ("Levenshtein", "NeedlemanWunsch", "SmithWaterman", "Gotoh", "DamerauLevenshtein", "Jaro",
                 "JaroWinkler"):
        got = D.block_scores(name, a, terms, q)
        ref = [D.py_measure(name, a, t, q) for t in terms]
        assert all(abs(x - y) < 1e-9 for x, y in zip(got, ref)), (name, a, terms, got, ref)
