"""Quality rules as a short-circuit cascade ordered by measured rejection per cost.

Every rule rejects a document by one feature of its whole text. On a small sample each
rule's cost (seconds for its feature) and selectivity (share of rejected documents) are
measured; the cascade then runs the rules by falling rejection per cost, and a rule sees
only what the ones before it kept. The order changes cost alone, never the verdict: a
document is kept when no rule rejects it.

Defined cases: a null text is an empty one (no words, rejected by ``few_words``); words are
runs without blank, tab, newline, vertical tab, form feed or carriage return; repeated rows
get equal results each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import text_batches
from kestrel.llm.textarrays import SPACED, Texts, Words, ngrams, ragged, runs, slices, span_digests, texts_of

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
UPPER = np.isin(np.arange(256), np.arange(65, 91))
LETTER = UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC0)  # a lead byte stands for its character
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """Counts per text, each computed when first asked for."""

    def __init__(self, texts: Texts):
        self.texts, self._have = texts, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._have:
            self._have[name] = getattr(self, "_" + name)()
        return self._have[name]

    def take(self, rows: np.ndarray) -> "Features":
        """The same for some of the texts; what is computed already comes along."""
        off, size = self.texts.off, np.diff(self.texts.off)[rows]
        out = Features(Texts(self.texts.data[ragged(off[:-1][rows], size)], np.append(0, np.cumsum(size))))
        out._have = {k: v[rows] for k, v in self._have.items() if k not in ("words", "lines")}
        return out

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[self.texts.off[1:]] - total[self.texts.off[:-1]]

    def _words(self) -> Words:
        return Words(self.texts, SPACED)

    def _n_words(self) -> np.ndarray:
        return self["words"].counts()

    def _word_chars(self) -> np.ndarray:
        return self._per_text((NOT_CONTINUATION & SPACED)[self.texts.data])

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(SYMBOLS[self.texts.data])

    def _n_letters(self) -> np.ndarray:
        return self._per_text(LETTER[self.texts.data])

    def _n_upper(self) -> np.ndarray:
        return self._per_text(UPPER[self.texts.data])

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text of every line with a word, and whether an earlier line of the text equals it."""
        data, off = self.texts.data, self.texts.off
        cuts = np.flatnonzero(data == 10)
        starts, ends = np.sort(np.append(off[:-1], cuts + 1)), np.sort(np.append(cuts, off[1:]))
        filled = np.append(0, np.cumsum(SPACED[data]))
        has = filled[ends] > filled[starts]
        starts, ends = starts[has], ends[has]
        doc = np.searchsorted(off, starts, side="right") - 1
        digest = span_digests(self.texts, starts, ends)
        order = np.lexsort((np.arange(len(doc)), digest, doc))
        again = np.ones(len(doc), bool)
        again[order[runs(doc[order], digest[order])[:-1]]] = False
        return doc, again

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self["lines"][0], minlength=len(self.texts))

    def _n_dup_lines(self) -> np.ndarray:
        doc, again = self["lines"]
        return np.bincount(doc[again], minlength=len(self.texts))

    def _n_repeat_words(self, width: int = 8) -> np.ndarray:
        words = self["words"]
        at, digest = ngrams(words.digests(), words.first, width)
        cover = np.zeros(len(words) + 1, np.int64)
        if len(at):
            doc = words.doc[at]
            order = np.lexsort((digest, doc))
            edge = runs(doc[order], digest[order])
            size = np.diff(edge)
            twice = at[order[np.repeat(size > 1, size)]]
            cover += np.bincount(twice, minlength=len(cover)) - np.bincount(twice + width, minlength=len(cover))
        hit = np.cumsum(cover)[:-1] > 0
        return np.bincount(words.doc[hit], minlength=len(self.texts))


@dataclass(frozen=True)
class Rule:
    """``rejects(features)`` flags the texts to drop; ``base`` rules make up ``base_failed``."""

    name: str
    rejects: Callable[[Features], np.ndarray]
    base: bool = False


#: The production rules. Limits are wide: only text that is clearly not prose goes.
RULES = (
    Rule("few_words", lambda f: f["n_words"] < 20, base=True),
    Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 30 * f["n_words"], base=True),
    Rule("symbols", lambda f: 2 * f["n_symbols"] > f["n_words"]),
    Rule("duplicate_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("few_letters", lambda f: 4 * f["n_letters"] < f["word_chars"]),
    Rule("shouting", lambda f: 10 * f["n_upper"] > 7 * np.maximum(f["n_letters"], 1)),
)


def measured_order(sample: Texts, rules: tuple[Rule, ...]) -> list[dict]:
    """Cost (seconds a text) and share rejected of each rule on the sample, best first.

    Every rule is timed on features of its own, so that none pays for another.
    """
    found = []
    for r in rules:
        began = time.perf_counter()
        share = float(np.mean(r.rejects(Features(sample)))) if len(sample) else 0.0
        cost = (time.perf_counter() - began) / max(1, len(sample))
        found.append({"rule": r.name, "cost": cost, "rejected": share, "rank": share / max(cost, 1e-12)})
    return sorted(found, key=lambda x: (-x["rank"], x["rule"]))


def run_cascade(features: Features, rules: list[Rule]) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 for none."""
    verdict = np.full(len(features.texts), -1)
    alive = rows = np.arange(len(features.texts))  # texts not rejected yet, and where ``features`` has them
    for k, rule in enumerate(rules):
        bad = rule.rejects(features)[rows]
        verdict[alive[bad]] = k
        alive, rows = alive[~bad], rows[~bad]
        if not len(alive):
            break
        if 2 * len(alive) < len(features.texts):  # worth copying the survivors' bytes
            features, rows = features.take(rows), np.arange(len(alive))
    return verdict


def quality_cascade(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
                    sample_docs: int = 400, features: tuple[str, ...] = BASE) -> DataFrame:
    """Verdict of the cascade for every document.

    Returns (doc_id, the asked features as long, base_failed, kept, rejected_by): the last
    names the first rule that rejected. The sample (``sample_docs`` documents) decides the
    order of the rules and nothing else.
    """
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = source.select("text").limit(sample_docs).toArrow()
    order = [x["rule"] for x in measured_order(texts_of(sample.column("text")), rules)]
    ordered = sorted(rules, key=lambda r: order.index(r.name))
    names = np.array([r.name for r in ordered] + [None], dtype=object)
    kind = source.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                f = Features(texts)
                cols = [pa.array(f[n].astype(np.int64)) for n in features]  # asked for, so shared with the rules
                failed = np.zeros(len(texts), bool)
                for r in rules:
                    if r.base:
                        failed |= r.rejects(f)
                first = run_cascade(f, ordered)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *cols, pa.array(failed), pa.array(first < 0),
                     pa.array(names[first], pa.string())],
                    names=["doc_id", *features, "base_failed", "kept", "rejected_by"])

    schema = f"doc_id {kind}, " + "".join(f"{n} long, " for n in features) \
        + "base_failed boolean, kept boolean, rejected_by string"
    return source.mapInArrow(judge, schema)
