"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different things: the text view the words of the whole text, their
beginnings and the text's shape; the metadata view language, source and length. They start
from the same labelled documents; each round, both models score all unlabelled documents, and
those that one is most sure of join the other model's training set. Both scores are calibrated
on held-out labels and combined by a third fit over the two. What is fitted on is bounded
(``max_labelled`` documents, picked by a digest of the id, and ``per_round`` of each round and
view; a linear model uses at most 6000 buckets, those that stand out by over 2.5 standard
deviations among the labelled); every document is scored, over its whole text. The features of
all documents are written once, as bucket lists, which sample, rounds and result read.

A document is bad when it is labelled quality 0 or toxic 1. Defined cases: a null text is an
empty one; null metadata is a value of its own; several label rows of one id are bad if any
is, null labels say nothing; without labels of both kinds every score is the share of bad
labels (0 without any), so nothing is rejected; repeated rows get equal results each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.cascade import Features
from kestrel.llm.staging import drop_staged, stage, text_batches, tidied
from kestrel.llm.textarrays import ALNUM, Texts, Words, mix, slices, span_digests, texts_of, with_field

BUCKETS = 1 << 20
PREFIX = 4
META = ("lang", "source", "n_chars")


def _bucket(digest: np.ndarray, kind: int) -> np.ndarray:
    return (mix(digest + np.uint64(kind)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bins(value: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), value, side="left")


def text_features(texts: Texts, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of words, word beginnings and shape, each once per text; only buckets marked in ``known``, if given."""
    low = texts.lower()
    words = Words(low, ALNUM)
    long = np.flatnonzero(words.end - words.start > PREFIX)
    begin = span_digests(low, words.start[long], words.start[long] + PREFIX)
    f = Features(texts)
    n = np.maximum(f["n_words"], 1)
    shape = [_bins(f["n_repeat_words"] / n, [0, 0.05, 0.15, 0.3, 0.6]), _bins(f["n_dup_lines"] / np.maximum(f["n_lines"], 1), [0, 0.1, 0.3, 0.6]),
             _bins(f["n_symbols"] / n, [0, 0.05, 0.2, 0.5]), _bins(f["n_upper"] / np.maximum(f["n_letters"], 1), [0.01, 0.1, 0.3, 0.6]),
             _bins(f["word_chars"] / n, [3, 4, 5, 6, 7, 9]), _bins(f["n_words"], [0, 5, 20, 100, 1000])]
    doc = np.concatenate([words.doc, words.doc[long], np.tile(np.arange(len(texts)), len(shape))])
    bucket = np.concatenate([_bucket(words.digests(), 1), _bucket(begin, 2)]
                            + [_bucket(s.astype(np.uint64) + np.uint64(1000 * k), 3) for k, s in enumerate(shape)])
    if known is not None:
        use = known[bucket]
        doc, bucket = doc[use], bucket[use]
    both = np.unique(doc * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def meta_features(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of language, source, both together and the size of the text."""
    lang, source, size = ([str(x) for x in rows.column(rows.schema.get_field_index(c)).to_pylist()] for c in META)
    size = [str(int(x).bit_length()) if x.lstrip("-").isdigit() else x for x in size]
    out = []
    for k, values in enumerate((lang, source, size, [a + "\0" + b for a, b in zip(lang, source)])):
        t = texts_of(pa.array(values, pa.string()))
        out.append(_bucket(span_digests(t, t.off[:-1], t.off[1:]), 10 + k))
    return np.tile(np.arange(len(rows)), len(out)), np.concatenate(out)


@dataclass
class Linear:
    """Logistic model over few chosen buckets."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def known(self) -> np.ndarray:
        out = np.zeros(BUCKETS, bool)
        out[self.buckets] = True
        return out

    def score(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        if not len(self.buckets):
            return np.full(n, self.bias)
        at = np.flatnonzero(self.known()[bucket])
        place = np.searchsorted(self.buckets, bucket[at])
        return self.bias + np.bincount(doc[at], self.weights[place], minlength=n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_linear(doc: np.ndarray, bucket: np.ndarray, y: np.ndarray, most: int = 6000, least_docs: int = 3,
               steps: int = 250) -> Linear:
    """Logistic regression over the ``most`` buckets whose presence tells the classes apart best."""
    n, bad = len(y), max(y.sum(), 1e-9)
    l2 = 2e-4 + 0.1 / n  # few rows, more shrinkage
    seen = np.bincount(bucket, minlength=BUCKETS)
    with_bad = np.bincount(bucket, y[doc], minlength=BUCKETS)
    share = bad / n
    z = np.abs(with_bad - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    z[seen < least_docs] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:most])
    chosen = chosen[z[chosen] > 2.5]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[bucket] >= 0
    row, col = doc[use], place[bucket[use]]
    w, b = np.zeros(len(chosen)), float(np.log((bad + 0.5) / (n - bad + 0.5)))
    gw, gb = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(steps):  # AdaGrad over all rows
        p = sigmoid(b + np.bincount(row, w[col], minlength=n)) - y
        dw = np.bincount(col, p[row], minlength=len(chosen)) / n + l2 * w
        db = p.mean()
        gw += dw * dw
        gb += db * db
        w -= 0.3 * dw / np.sqrt(gw)
        b -= 0.1 * db / np.sqrt(gb)
    return Linear(chosen, w, b)


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights and bias of a small logistic regression (Newton steps)."""
    a = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge, a.T @ (p - y) / len(y) + ridge @ w)
        w -= np.clip(step, -3, 3)
    return w


@dataclass
class CoTrained:
    text: Linear
    meta: Linear
    text_scale: np.ndarray  # calibration of each view: slope, offset
    meta_scale: np.ndarray
    mix: np.ndarray  # weights of both calibrated views, offset

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = text * self.text_scale[0] + self.text_scale[1], meta * self.meta_scale[0] + self.meta_scale[1]
        return sigmoid(a), sigmoid(b), sigmoid(a * self.mix[0] + b * self.mix[1] + self.mix[2])


def _rows(feature: tuple[np.ndarray, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of some rows, renumbered in the order of ``keep``."""
    number = np.full(int(max(feature[0].max(initial=-1), keep.max(initial=-1))) + 1, -1)
    number[keep] = np.arange(len(keep))
    to = number[feature[0]]
    return to[to >= 0], feature[1][to >= 0]


def co_train(text: tuple[np.ndarray, np.ndarray], meta: tuple[np.ndarray, np.ndarray], y: np.ndarray, fold: np.ndarray,
             rounds: int, per_round: int, sure: float, surest: Callable) -> CoTrained:
    """``y`` is 1 (bad) or 0; a quarter of the labels (by ``fold``) calibrates.

    ``surest(models, taken, want)`` gives for each view the keys, labels and features (text,
    meta) of the unlabelled documents its model is most sure of, without those in ``taken``.
    """
    views = {"text": text, "meta": meta}
    held, start = np.flatnonzero(fold % 4 == 0), np.flatnonzero(fold % 4 != 0)
    if len(np.unique(y[held])) < 2 or len(np.unique(y[start])) < 2:
        share = float(y.mean()) if len(y) else 0.0
        none = Linear(np.empty(0, np.int64), np.empty(0), 0.0)
        odds = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return CoTrained(none, none, np.array([0, odds]), np.array([0, odds]), np.array([0, 0, min(odds, -1.0)]))
    train = {v: _rows(views[v], start) for v in views}
    labels = {v: y[start].astype(float) for v in views}
    taken: dict[str, set] = {v: set() for v in views}  # by the view that they train
    share = y[start].mean()
    # as many of each class as their share among the labels, the surest first
    want = {1: int(round(per_round * share)), 0: int(round(per_round * (1 - share)))}
    other = {"text": "meta", "meta": "text"}

    def fit(v: str) -> tuple[Linear, np.ndarray]:
        model = fit_linear(*train[v], labels[v])
        x = model.score(*_rows(views[v], held), len(held))
        return model, fit_dense(x[:, None], y[held].astype(float))

    for _ in range(rounds):
        models = {v: fit(v) for v in views}
        found = surest(models, {v: taken[other[v]] for v in views}, want, sure)
        for v, (keys, marks, features) in found.items():
            o = other[v]
            at, bucket = features[o]
            train[o] = np.concatenate([train[o][0], at + len(labels[o])]), np.concatenate([train[o][1], bucket])
            labels[o] = np.concatenate([labels[o], marks])
            taken[o].update(keys)
    (t, ts), (m, ms) = fit("text"), fit("meta")
    x = np.column_stack([t.score(*_rows(text, held), len(held)) * ts[0] + ts[1],
                         m.score(*_rows(meta, held), len(held)) * ms[0] + ms[1]])
    return CoTrained(t, m, ts, ms, fit_dense(x, y[held].astype(float)))


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
                                     *[F.col(c).cast("string").alias(c) for c in META])


def _listed(feature: tuple[np.ndarray, np.ndarray], n: int) -> pa.Array:
    """Buckets of each row, ascending."""
    at, bucket = feature
    order = np.lexsort((bucket, at))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], np.arange(n + 1)).astype(np.int32)), pa.array(bucket[order].astype(np.int32)))


def quality_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, text, meta): the buckets of both views of every row, written once.

    ``key`` is a digest of every column that is read; rows equal in it are equal here.
    """
    source = _source(docs, doc_id, text)
    columns = ("doc_id", "text", *META)
    source = source.select("doc_id", F.xxhash64(*columns, *[F.col(c).isNull() for c in columns]).alias("key"), "text", *META)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                n = len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _listed(text_features(texts), n), _listed(meta_features(part), n)],
                                                 names=["doc_id", "key", "text", "meta"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return stage(source.mapInArrow(tidied(run), f"doc_id {kind}, key long, text array<int>, meta array<int>"), "features")


def _sample(features: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` different labelled rows, picked by a digest of the id: (doc_id, key, text, meta, y)."""
    marked = labels.groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = features.select("doc_id", "key").filter("doc_id is not null").distinct()
    known = rows.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(max_labelled)
    return features.join(F.broadcast(known.select("key", "y")), "key").dropDuplicates(["key"])  # at most max_labelled keys


def _collected(rows: DataFrame) -> pa.Table:
    """(doc_id, key, text, meta, y) of few rows, in an order of their own."""
    got = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "key", "text", "meta", "y").toArrow().combine_chunks()
    names, keys = got.column("doc_id").to_pylist(), got.column("key").to_pylist()
    order = sorted(range(len(got)), key=lambda i: (names[i] or "", keys[i]))  # so that the fit does not depend on task order
    return got.take(pa.array(np.array(order, np.int64)))


def _pairs(got: pa.Table | pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = got.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths()) if len(column) else np.empty(0, int)
    return np.repeat(np.arange(len(column)), size), np.asarray(column.flatten()).astype(np.int64)


def _surest(features: DataFrame, labels: DataFrame) -> Callable:
    """Search of the surest documents among all without a label; rows equal in every column that is read count once."""
    def search(models: dict, taken: dict, want: dict, sure: float) -> dict:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = []
                for v in ("text", "meta"):
                    model, scale = models[v]
                    p.append(pa.array(sigmoid(model.score(*_pairs(batch, v), len(batch)) * scale[0] + scale[1])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *p], names=["doc_id", "key", "text", "meta"])

        kind = features.schema["doc_id"].dataType.simpleString()
        scored = features.mapInArrow(run, f"doc_id {kind}, key long, text double, meta double") \
            .filter(" or ".join(f"{v} >= {sure} or {v} <= {1 - sure}" for v in models))
        scored = stage(scored.join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("key", "text", "meta").distinct(), "sure")
        marks: dict[str, dict] = {v: {} for v in models}
        for v in models:
            for mark, fits, order in ((1, F.col(v) >= sure, F.col(v).desc()), (0, F.col(v) <= 1 - sure, F.col(v).asc())):
                top = scored.filter(fits).orderBy(order, F.xxhash64("key"), "key").select("key").limit(want[mark] + len(taken[v])).collect()
                free = [r["key"] for r in top if r["key"] not in taken[v]]
                marks[v].update((k, float(mark)) for k in free[: want[mark]])
        drop_staged(scored)
        keys = sorted({k for m in marks.values() for k in m})
        picked = features.sparkSession.createDataFrame([(k,) for k in keys], "key long")
        got = _collected(features.join(F.broadcast(picked), "key").withColumn("y", F.lit(-1)).dropDuplicates(["key"]))
        out = {}
        for v, mark in marks.items():
            own = got.filter(pa.array([k in mark for k in got.column("key").to_pylist()], pa.bool_()))
            names = own.column("key").to_pylist()
            out[v] = names, np.array([mark[k] for k in names], float), {w: _pairs(own, w) for w in models}
        return out

    return search


def fit_quality_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = 8000,
                      rounds: int = 3, per_round: int = 300, sure: float = 0.95, features: DataFrame | None = None) -> CoTrained:
    """Fit both views on at most ``max_labelled`` labelled documents and the surest of all others.

    ``features`` are those of ``docs`` where they have been written already.
    """
    features = quality_features(docs, doc_id, text) if features is None else features
    bad = F.greatest(1 - F.col("quality").cast("int"), F.col("toxic").cast("int"))  # nulls are skipped
    marked = labels.select(F.col("doc_id"), bad.alias("y")).filter("doc_id is not null and y is not null")
    got = _collected(_sample(features, marked, max_labelled))
    names = texts_of(got.column("doc_id"))
    fold = span_digests(names, names.off[:-1], names.off[1:]) % np.uint64(1 << 20)
    return co_train(_pairs(got, "text"), _pairs(got, "meta"), np.asarray(got.column("y"), np.int64), fold, rounds, per_round, sure,
                    _surest(features, marked))


def score_quality(docs: DataFrame, model: CoTrained, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5,
                  features: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_score, meta_score, score, rejected) of every document: chances of being bad."""
    features = quality_features(docs, doc_id, text) if features is None else features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = model.scores(*(m.score(*_pairs(batch, v), len(batch)) for v, m in (("text", model.text), ("meta", model.meta))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= threshold)],
                                             names=["doc_id", "text_score", "meta_score", "score", "rejected"])

    return features.mapInArrow(run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, text_score double, "
                                    "meta_score double, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: CoTrained, doc_id: str = "doc_id", text: str = "text",
                  threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns, in one pass."""
    names = docs.columns
    plain = text_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole"),
                                      *[F.col(c).cast("string").alias(c) for c in META])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(with_field(batch, "whole", text, "\0text"), "\0text"):
                n = len(texts)
                score = model.scores(model.text.score(*text_features(texts, model.text.known()), n), model.meta.score(*meta_features(part), n))[2]
                yield pa.RecordBatch.from_arrays([part.column(0)], names=["whole"]).filter(pa.array(score < threshold))

    return plain.mapInArrow(tidied(run), f"whole {plain.schema['whole'].dataType.simpleString()}").select("whole.*")
