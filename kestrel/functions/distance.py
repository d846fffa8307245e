"""String distance and similarity measures.

The multiset q-gram measures (Overlap, Cosine, Jaccard, Tversky, Sorensen), Hamming and
Levenshtein are ranked through indexes (``operators.nearest``); their grams come from
built-in functions. The alignment measures with no built-in counterpart (Damerau-Levenshtein, Jaro, Jaro-Winkler, StrCmp95,
Needleman-Wunsch, Gotoh, Smith-Waterman) are small per-pair helpers called
from an Arrow-batched pandas UDF that scores one input against a block of
terms at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from kestrel.functions.text import qgrams

EDIT = ("Hamming", "Levenshtein", "DamerauLevenshtein", "Jaro", "JaroWinkler",
        "StrCmp95", "NeedlemanWunsch", "Gotoh", "SmithWaterman")
TOKEN = ("Overlap", "Cosine", "Jaccard", "Tversky", "Sorensen")
FEASIBLE = EDIT + TOKEN
# measures ranked high-to-low (similarities); the rest are distances ranked low-to-high
REVERSE = ("Jaro", "JaroWinkler", "NeedlemanWunsch", "SmithWaterman", "Gotoh", "StrCmp95",
           "Overlap", "Jaccard", "Cosine", "Tversky", "Sorensen")


# ---------------------------------------------------------------------------
# native expressions
# ---------------------------------------------------------------------------

def gram_tags(col: Column, q: int) -> Column:
    """The q-gram multiset as a set: the k-th occurrence of gram g becomes "g<SOH>k".
    Multiset intersection sizes then come from ``array_intersect`` (hash based, no
    per-pair map scans)."""
    from kestrel.functions.text import let
    return let(qgrams(col, q), lambda g: F.transform(
        g, lambda x, i: F.concat(x, F.lit("\u0001"), F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x))
                                 .cast("string"))))


# ---------------------------------------------------------------------------
# per-pair helpers for the Arrow UDF
# ---------------------------------------------------------------------------

def _seq(s: str, q: int):
    if q <= 0:
        return s.split()
    if q == 1:
        return s
    return [s[i:i + q] for i in range(len(s) - q + 1)]


def py_levenshtein(a, b) -> float:
    if a == b:
        return 0.0
    if not a or not b:
        return float(max(len(a), len(b)))
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return float(prev[-1])


def py_hamming(a, b) -> float:
    if a == b:
        return 0.0
    n = max(len(a), len(b))
    return float(sum(1 for i in range(n) if i >= len(a) or i >= len(b) or a[i] != b[i]))


def py_damerau(a, b) -> float:
    """Unrestricted Damerau-Levenshtein (adjacent transpositions may be edited again)."""
    if a == b:
        return 0.0
    if not a or not b:
        return float(max(len(a), len(b)))
    la, lb = len(a), len(b)
    inf = la + lb
    d = [[0] * (lb + 2) for _ in range(la + 2)]
    d[0][0] = inf
    for i in range(la + 1):
        d[i + 1][0] = inf
        d[i + 1][1] = i
    for j in range(lb + 1):
        d[0][j + 1] = inf
        d[1][j + 1] = j
    last = {}
    for i in range(1, la + 1):
        db = 0
        for j in range(1, lb + 1):
            i1 = last.get(b[j - 1], 0)
            j1 = db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost = 0
                db = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1,
                                  d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return float(d[la + 1][lb + 1])


def _jaro_core(s1, s2):
    l1, l2 = len(s1), len(s2)
    rng = max(max(l1, l2) // 2 - 1, 0)
    f1, f2 = [False] * l1, [False] * l2
    common = 0
    for i, ch in enumerate(s1):
        lo, hi = max(0, i - rng), min(i + rng, l2 - 1)
        for j in range(lo, hi + 1):
            if not f2[j] and s2[j] == ch:
                f1[i] = f2[j] = True
                common += 1
                break
    if not common:
        return 0.0, 0, f1, f2
    k = trans = 0
    for i, flag in enumerate(f1):
        if flag:
            for j in range(k, l2):
                if f2[j]:
                    k = j + 1
                    break
            if s1[i] != s2[j]:
                trans += 1
    trans //= 2
    w = (common / l1 + common / l2 + (common - trans) / common) / 3
    return w, common, f1, f2


def py_jaro(s1, s2, winkler: bool = False) -> float:
    if s1 == s2:
        return 1.0
    if not s1 or not s2:
        return 0.0
    w, _, _, _ = _jaro_core(s1, s2)
    if not winkler or w <= 0.7:
        return w
    lim = min(len(s1), len(s2), 4)
    i = 0
    while i < lim and s1[i] == s2[i]:
        i += 1
    return w + i * 0.1 * (1.0 - w) if i else w


# StrCmp95 pairs of characters that earn partial credit (3/10 of a match).
STRCMP95_SIMILAR = (
    ("A", "E"), ("A", "I"), ("A", "O"), ("A", "U"), ("B", "V"), ("E", "I"),
    ("E", "O"), ("E", "U"), ("I", "O"), ("I", "U"), ("O", "U"), ("I", "Y"),
    ("E", "Y"), ("C", "G"), ("E", "F"), ("W", "U"), ("W", "V"), ("X", "K"),
    ("S", "Z"), ("X", "S"), ("Q", "C"), ("U", "V"), ("M", "N"), ("L", "I"),
    ("Q", "O"), ("P", "R"), ("I", "J"), ("2", "Z"), ("5", "S"), ("8", "B"),
    ("1", "I"), ("1", "L"), ("0", "O"), ("0", "Q"), ("C", "K"), ("G", "J"),
)
_ADJ = {p for a, b in STRCMP95_SIMILAR for p in ((a, b), (b, a))}


def py_strcmp95(s1: str, s2: str) -> float:
    s1, s2 = s1.strip().upper(), s2.strip().upper()
    if s1 == s2:
        return 1.0
    if not s1 or not s2:
        return 0.0
    l1, l2 = len(s1), len(s2)
    minv = min(l1, l2)
    _, common, f1, f2 = _jaro_core(s1, s2)
    if not common:
        return 0.0
    f2 = [1 if x else 0 for x in f2]
    k = trans = 0
    for i in range(l1):
        if not f1[i]:
            continue
        for j in range(k, l2):
            if f2[j]:
                k = j + 1
                break
        if s1[i] != s2[j]:
            trans += 1
    trans //= 2
    simi = 0
    if minv > common:
        for i in range(l1):
            if f1[i] or not (0 < ord(s1[i]) < 91):
                continue
            for j in range(l2):
                if f2[j] or not (0 < ord(s2[j]) < 91):
                    continue
                if (s1[i], s2[j]) in _ADJ:
                    simi += 3
                    f2[j] = 2
                    break
    num_sim = simi / 10.0 + common
    w = (num_sim / l1 + num_sim / l2 + (common - trans) / common) / 3.0
    if w <= 0.7:
        return w
    lim = min(minv, 4)
    i = 0
    while i < lim and s1[i] == s2[i] and not s1[i].isdigit():
        i += 1
    return w + i * 0.1 * (1.0 - w) if i else w


def py_needleman_wunsch(s1, s2, gap: float = 1.0) -> float:
    prev = [-(j * gap) for j in range(len(s2) + 1)]
    for i, c1 in enumerate(s1, 1):
        cur = [-(i * gap)]
        for j, c2 in enumerate(s2, 1):
            cur.append(max(prev[j - 1] + (1.0 if c1 == c2 else 0.0), prev[j] - gap, cur[j - 1] - gap))
        prev = cur
    return float(prev[-1])


def py_smith_waterman(s1, s2, gap: float = 1.0) -> float:
    """Local alignment score read at the last cell of the table."""
    prev = [0.0] * (len(s2) + 1)
    for c1 in s1:
        cur = [0.0]
        for j, c2 in enumerate(s2, 1):
            cur.append(max(0.0, prev[j - 1] + (1.0 if c1 == c2 else 0.0), prev[j] - gap, cur[j - 1] - gap))
        prev = cur
    return float(prev[-1])


def py_gotoh(s1, s2, gap_open: float = 1.0, gap_ext: float = 0.4) -> float:
    """Affine-gap global alignment (match 1, mismatch 0)."""
    ninf = float("-inf")
    l1, l2 = len(s1), len(s2)
    d = [[0.0] * (l2 + 1) for _ in range(l1 + 1)]
    p = [[0.0] * (l2 + 1) for _ in range(l1 + 1)]
    qm = [[0.0] * (l2 + 1) for _ in range(l1 + 1)]
    p[0][0] = qm[0][0] = ninf
    for i in range(1, l1 + 1):
        d[i][0] = ninf
        p[i][0] = -gap_open - gap_ext * (i - 1)
        qm[i][0] = ninf
    for j in range(1, l2 + 1):
        d[0][j] = ninf
        p[0][j] = ninf
        qm[0][j] = -gap_open - gap_ext * (j - 1)
    for i in range(1, l1 + 1):
        for j in range(1, l2 + 1):
            sim = 1.0 if s1[i - 1] == s2[j - 1] else 0.0
            d[i][j] = max(d[i - 1][j - 1], p[i - 1][j - 1], qm[i - 1][j - 1]) + sim
            p[i][j] = max(d[i - 1][j] - gap_open, p[i - 1][j] - gap_ext)
            qm[i][j] = max(d[i][j - 1] - gap_open, qm[i][j - 1] - gap_ext)
    return float(max(d[l1][l2], p[l1][l2], qm[l1][l2]))


def py_token(name: str, a, b) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    ca, cb = Counter(a), Counter(b)
    inter = sum((ca & cb).values())
    na, nb = sum(ca.values()), sum(cb.values())
    if name == "Overlap":
        return inter / min(na, nb)
    if name == "Cosine":
        return inter / (na * nb) ** 0.5
    if name in ("Jaccard", "Tversky"):
        return inter / (na + nb - inter)
    if name == "Sorensen":
        return 2 * inter / (na + nb)
    raise ValueError(name)


def py_measure(name: str, a: str, b: str, q: int = 1) -> float:
    """Reference implementation of every measure on two strings (also used in tests)."""
    if name == "StrCmp95":
        return py_strcmp95(a, b)
    sa, sb = _seq(a, q), _seq(b, q)
    if name in TOKEN:
        return py_token(name, sa, sb)
    fn = {"Hamming": py_hamming, "Levenshtein": py_levenshtein, "DamerauLevenshtein": py_damerau,
          "Jaro": py_jaro, "JaroWinkler": lambda x, y: py_jaro(x, y, True),
          "NeedlemanWunsch": py_needleman_wunsch, "Gotoh": py_gotoh,
          "SmithWaterman": py_smith_waterman}[name]
    return fn(sa, sb)


# ---------------------------------------------------------------------------
# one input against a block of terms: dynamic programmes vectorised over the terms
# ---------------------------------------------------------------------------

def _encode(a, terms):
    """Integer codes of the input and of the padded terms (pad = -1), term lengths."""
    vocab: dict = {}
    ca = np.array([vocab.setdefault(x, len(vocab)) for x in a], dtype=np.int64)
    lens = np.array([len(t) for t in terms], dtype=np.int64)
    width = int(lens.max()) if len(lens) else 0
    mat = np.full((len(terms), width), -1, dtype=np.int64)
    for k, t in enumerate(terms):
        if len(t):
            mat[k, :len(t)] = [vocab.setdefault(x, len(vocab)) for x in t]
    return ca, mat, lens, len(vocab)


def _np_linear(name: str, a, terms, gap: float = 1.0) -> np.ndarray:
    """Levenshtein, Needleman-Wunsch, Smith-Waterman for one input vs many terms."""
    ca, mat, lens, _ = _encode(a, terms)
    n, width = mat.shape
    j = np.arange(width + 1, dtype=float)
    if name == "Levenshtein":
        prev = np.tile(j, (n, 1))
    elif name == "NeedlemanWunsch":
        prev = np.tile(-j * gap, (n, 1))
    else:
        prev = np.zeros((n, width + 1))
    for i, c in enumerate(ca, 1):
        cur = np.empty_like(prev)
        cur[:, 0] = i if name == "Levenshtein" else (-(i * gap) if name == "NeedlemanWunsch" else 0.0)
        eq = (mat == c)
        for k in range(1, width + 1):
            if name == "Levenshtein":
                cur[:, k] = np.minimum(np.minimum(prev[:, k] + 1, cur[:, k - 1] + 1), prev[:, k - 1] + ~eq[:, k - 1])
            else:
                v = np.maximum(np.maximum(prev[:, k - 1] + eq[:, k - 1], prev[:, k] - gap), cur[:, k - 1] - gap)
                cur[:, k] = np.maximum(v, 0.0) if name == "SmithWaterman" else v
        prev = cur
    return prev[np.arange(n), lens]


def _np_gotoh(a, terms, go: float = 1.0, ge: float = 0.4) -> np.ndarray:
    ca, mat, lens, _ = _encode(a, terms)
    n, width = mat.shape
    ninf = -np.inf
    j = np.arange(width + 1, dtype=float)
    d = np.full((n, width + 1), ninf)
    d[:, 0] = 0.0
    p = np.full((n, width + 1), ninf)
    qq = np.tile(-go - ge * (j - 1), (n, 1))
    qq[:, 0] = ninf
    for i, c in enumerate(ca, 1):
        eq = (mat == c).astype(float)
        dn, pn, qn = np.empty_like(d), np.empty_like(p), np.empty_like(qq)
        dn[:, 0], pn[:, 0], qn[:, 0] = ninf, -go - ge * (i - 1), ninf
        pn[:, 1:] = np.maximum(d[:, 1:] - go, p[:, 1:] - ge)
        dn[:, 1:] = np.maximum(np.maximum(d[:, :-1], p[:, :-1]), qq[:, :-1]) + eq
        for k in range(1, width + 1):
            qn[:, k] = np.maximum(dn[:, k - 1] - go, qn[:, k - 1] - ge)
        d, p, qq = dn, pn, qn
    idx = np.arange(n)
    return np.maximum(np.maximum(d[idx, lens], p[idx, lens]), qq[idx, lens])


def _np_damerau(a, terms) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein of one input against many terms."""
    ca, mat, lens, nv = _encode(a, terms)
    n, width = mat.shape
    la = len(ca)
    inf = (la + lens).astype(float)
    d = np.zeros((n, la + 2, width + 2))
    d[:, 0, :] = inf[:, None]
    d[:, :, 0] = inf[:, None]
    d[:, 1:, 1] = np.arange(la + 1)[None, :]
    d[:, 1, 1:] = np.arange(width + 1)[None, :]
    last = np.zeros(nv + 1, dtype=np.int64)  # last row of each code in the input; index nv = padding
    codes = np.where(mat >= 0, mat, nv)
    rows = np.arange(n)
    for i in range(1, la + 1):
        db = np.zeros(n, dtype=np.int64)
        for k in range(1, width + 1):
            i1 = last[codes[:, k - 1]]
            j1 = db
            match = mat[:, k - 1] == ca[i - 1]
            cost = np.where(match, 0.0, 1.0)
            trans = d[rows, i1, j1] + (i - i1 - 1) + 1 + (k - j1 - 1)
            d[:, i + 1, k + 1] = np.minimum(np.minimum(d[:, i, k] + cost, d[:, i + 1, k] + 1),
                                            np.minimum(d[:, i, k + 1] + 1, trans))
            db = np.where(match, k, db)
        last[ca[i - 1]] = i
    return d[rows, la + 1, lens + 1]


def _np_jaro(a, terms, winkler: bool) -> np.ndarray:
    """Jaro / Jaro-Winkler of one input against many terms: the greedy in-window
    matching runs once per input character over all terms at the same time."""
    ca, mat, lens, _ = _encode(a, terms)
    n, width = mat.shape
    l1 = len(ca)
    out = np.zeros(n)
    if l1 == 0 or width == 0:
        return out
    rng = np.maximum(np.maximum(l1, lens) // 2 - 1, 0)
    f1 = np.zeros((n, l1), dtype=bool)
    f2 = np.zeros((n, width), dtype=bool)
    pos = np.arange(width)[None, :]
    for i in range(l1):
        lo = np.maximum(0, i - rng)[:, None]
        hi = np.minimum(i + rng, lens - 1)[:, None]
        cand = ~f2 & (mat == ca[i]) & (pos >= lo) & (pos <= hi)
        rows = np.nonzero(cand.any(axis=1))[0]
        cols = cand[rows].argmax(axis=1)
        f2[rows, cols] = True
        f1[rows, i] = True
    common = f1.sum(axis=1)
    k = min(l1, width)
    m1 = np.full((n, l1), -2)
    r, c = np.nonzero(f1)
    m1[r, (np.cumsum(f1, axis=1) - 1)[r, c]] = ca[c]
    m2 = np.full((n, width), -3)
    r, c = np.nonzero(f2)
    m2[r, (np.cumsum(f2, axis=1) - 1)[r, c]] = mat[r, c]
    trans = ((m1[:, :k] != m2[:, :k]) & (np.arange(k)[None, :] < common[:, None])).sum(axis=1) // 2
    ok = common > 0
    cm = np.where(ok, common, 1)
    w = np.where(ok, (common / l1 + common / np.maximum(lens, 1) + (common - trans) / cm) / 3, 0.0)
    if winkler:
        lim = np.minimum(np.minimum(lens, l1), 4)
        run = np.ones(n, dtype=bool)
        pref = np.zeros(n)
        for p in range(min(4, l1, width)):
            run &= (mat[:, p] == ca[p]) & (p < lim)
            pref += run
        w = np.where(w > 0.7, w + pref * 0.1 * (1.0 - w), w)
    out[:] = w
    return out


def block_scores(name: str, a: str, terms: list[str], q: int = 1) -> list[float]:
    """Scores of one input against a block of terms; the dynamic programmes run once
    for the whole block (numpy over the terms), other measures pair by pair."""
    if name in ("Levenshtein", "NeedlemanWunsch", "SmithWaterman", "Gotoh", "DamerauLevenshtein") and len(terms):
        sa = _seq(a, q)
        st = [_seq(t, q) for t in terms]
        if name == "Gotoh":
            out = _np_gotoh(sa, st)
        elif name == "DamerauLevenshtein":
            out = _np_damerau(sa, st)
        else:
            out = _np_linear(name, sa, st)
        if name in ("Levenshtein", "DamerauLevenshtein"):  # identical / empty shortcuts of a distance
            out = np.array([0.0 if list(sa) == list(t) else (float(max(len(sa), len(t))) if not len(sa) or not len(t)
                                                          else v) for t, v in zip(st, out)])
        return [float(v) for v in out]
    if name in ("Jaro", "JaroWinkler") and len(terms):
        sa = _seq(a, q)
        st = [_seq(t, q) for t in terms]
        out = _np_jaro(sa, st, name == "JaroWinkler")
        return [1.0 if list(sa) == list(t) else (0.0 if not len(sa) or not len(t) else float(v))
                for t, v in zip(st, out)]
    return [py_measure(name, a, t, q) for t in terms]


def block_scores_udf(name: str, q: int = 1):
    """pandas UDF: (input string, array of terms) -> array of scores, one Arrow batch at a time."""

    @F.pandas_udf(TY.ArrayType(TY.DoubleType()))
    def scores(inputs: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([block_scores(name, a, list(ts), q) for a, ts in zip(inputs, terms)])

    return scores
