"""Indexes of the nearest-match search against brute force, over shards, and the work they save."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrel.functions import distance as D
from kestrel.operators import matching as M
from kestrel.operators import nearest as N


def strings(rng, n, alphabet, longest):
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)})


def tagged(s):
    seen = {}
    for g in s:
        seen[g] = seen.get(g, 0) + 1
        yield f"{g}\x01{seen[g]}"


@pytest.mark.parametrize("alphabet,longest", [("ab", 4), ("abcdef", 12), ("abé日🙂", 90), ("abcdefghij", 30)])
def test_edit_index(alphabet, longest):
    rng = random.Random(longest)
    many, some = strings(rng, 60, alphabet, longest), strings(rng, 20, alphabet, longest)
    rng.shuffle(many)
    for shifts, name in ((True, "Levenshtein"), (False, "Hamming")):
        index = N.EditIndex(pa.array(many, pa.string()), shifts)
        for x in some:
            for n in (1, 5):
                got = [(float(d), index.strings[m]) for m, d in zip(*index.search(x, n))]
                assert got == sorted((D.py_measure(name, x, s), s) for s in many)[:n]


@pytest.mark.parametrize("measure", D.TOKEN)
def test_gram_index(measure):
    rng = random.Random(5)
    for alphabet, longest in (("ab", 4), ("abcdef", 12), ("abcdefghijklmnop", 40)):
        many, some = strings(rng, 60, alphabet, longest), strings(rng, 20, alphabet, longest)
        lists = lambda s: pa.array([list(tagged(x)) for x in s], pa.list_(pa.string()))
        index = N.GramIndex(pa.array(many, pa.string()), lists(many), measure)
        batch = pa.RecordBatch.from_arrays([pa.array(some, pa.string()), lists(some)], names=["key", "terms"])
        names = index.keys.to_pylist()
        for x, (match, score) in zip(some, index.answer(batch, 5)):
            got = sorted((-round(float(s), 4), names[m]) for m, s in zip(match, score))[:5]
            assert got == sorted((-round(D.py_measure(measure, x, s), 4), s) for s in many)[:5]


@pytest.mark.parametrize("size", [0, 1, 5, 300])
def test_cosine_index(size):
    rng = random.Random(size)
    vocabulary = [f"t{i}" for i in range(40)]
    vector = lambda: dict((t, rng.choice([0.25, rng.random()])) for t in rng.sample(vocabulary, rng.randrange(0, 8)))
    many, some = [(f"k{i}", vector()) for i in range(size)], [vector() for _ in range(30)]
    rng.shuffle(many)
    lists = lambda vs: (pa.array([list(v) for v in vs], pa.list_(pa.string())), pa.array([list(v.values()) for v in vs], pa.list_(pa.float64())))
    index = N.CosineIndex(pa.array([k for k, _ in many], pa.string()), *lists([v for _, v in many]))
    batch = pa.RecordBatch.from_arrays(list(lists(some)), names=["terms", "weights"])
    names = index.keys.to_pylist()
    for x, (match, score) in zip(some, index.answer(batch, 4)):
        want = sorted((-round(sum(x.get(t, 0) * w for t, w in v.items()), 4), k) for k, v in many)
        got = sorted((-round(float(s), 4), names[m]) for m, s in zip(match, score) if round(float(s), 4) > 0)[:4]
        assert got == [w for w in want if w[0] < 0][:4]


def names_of(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    return M.normalize_key(part, "p_brand", "p_name"), M.normalize_key(part, "p_type", "p_name")


@pytest.mark.parametrize("algorithm", ["Jaccard", "Levenshtein", "Hamming"])
def test_shards_and_chunks_change_nothing(spark, monkeypatch, algorithm):
    inputs, terms = names_of(spark)
    want = sorted(map(tuple, M.textdist_match(inputs, terms, "key", "key", algorithm, 1, 3).collect()))
    monkeypatch.setattr(N, "SHARD_LOAD", 900)
    monkeypatch.setattr(N, "CHUNK_LOAD", 1500)
    monkeypatch.setattr(N, "STRING_LOAD", 900)
    monkeypatch.setattr(N.nearest, "__defaults__", (900, 1500))
    assert sorted(map(tuple, M.textdist_match(inputs, terms, "key", "key", algorithm, 1, 3).collect())) == want


def test_rows_after_the_search(spark):
    """At most inputs x n x shards rows leave the tasks, with a term that is in every string."""
    rng = random.Random(3)
    some = [(f"hot {rng.randrange(50)} {rng.randrange(50)} {i}",) for i in range(400)]
    df = spark.createDataFrame(some, "k string")
    docs = M.match_documents(df, df, "k", "k")
    vectors = M.weight_vectors(M.tfidf_weights(docs, "word", 1)).cache()
    sides = [vectors.where(F.col("side") == s).drop("side") for s in "im"]
    found = N.nearest(*sides, F.size("terms"), N.cosine_index, 3, shard_load=500, chunk_load=300).cache()
    shards = -(-sides[1].agg(F.sum(F.size("terms"))).first()[0] // 500)
    assert shards > 1 and found.where("match IS NOT NULL").count() <= 400 * 3 * shards
    best = M.top_n(found.select("input", "match", F.round("score", 4).alias("score")).where("score > 0"), 3)
    want = M.top_n(M.sparse_cosine(M.tfidf_weights(docs, "word", 1)), 3)
    key = ["input", "rank", "match", "score"]
    assert sorted(map(tuple, best.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def by_size_bound(inputs, terms, algorithm, n):
    """Pairs that a loop over term sizes scores, in the order of their bound until it is below the n-th best."""
    total = 0
    for x in inputs:
        sizes = sorted({len(t) for t in terms}, key=lambda t: -min(len(x), t) / max(len(x), t) if algorithm == "Jaccard" else abs(len(x) - t))
        best = []
        for size in sizes:
            bound = min(len(x), size) / max(len(x), size) if algorithm == "Jaccard" else -abs(len(x) - size)
            if len(best) == n and bound < best[-1]:
                break
            group = [t for t in terms if len(t) == size]
            total += len(group)
            sign = 1 if algorithm == "Jaccard" else -1
            best = sorted(best + [sign * D.py_measure(algorithm, x, t) for t in group], reverse=True)[:n]
    return total


@pytest.mark.parametrize("algorithm", ["Jaccard", "Levenshtein"])
def test_fewer_pairs_than_by_size(spark, algorithm):
    inputs, terms = names_of(spark)
    work = M.textdist_match(inputs, terms, "key", "key", algorithm, 1, 5, with_work=True).collect()
    x, t = ([r.key for r in d.collect()] for d in (inputs, terms))
    assert len(work) == len(x)
    assert 0 < sum(r.scored for r in work) < by_size_bound(x, t, algorithm, 5)


def test_awkward_inputs(spark):
    df = spark.createDataFrame([("",), (None,), ("a",), ("a",), ("äöü",)], "k string")
    none = spark.createDataFrame([], "k string")
    for algorithm in ("Jaccard", "Overlap", "Levenshtein", "Hamming", "Jaro"):
        assert M.textdist_match(none, df, "k", "k", algorithm).count() == 0
        assert M.textdist_match(df, none, "k", "k", algorithm).count() == 0
        got = {(r.input, r.match): r.score for r in M.textdist_match(df, df, "k", "k", algorithm).collect()}
        assert len(got) == 9 and all(got[x, x] == (0.0 if algorithm in ("Levenshtein", "Hamming") else 1.0) for x in ("", "a", "äöü"))
    assert M.tfidf_match(none, df, "k", "k").count() == 0 and M.tfidf_match(df, none, "k", "k").count() == 0
    with pytest.raises(ValueError):
        M.textdist_match(df, df, "k", "k", "Soundex")
