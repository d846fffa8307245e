"""License scan with ordered signature rules.

A text (A-Z lower-cased, every run of white space made one blank) is first searched for the
rules' keywords with one Aho-Corasick automaton; only rules whose keyword occurs run their
regular expression, over the whole text. Positions of detections are those of the text itself.
Detections are then resolved in the order of the rules' priority: one whose interval lies
inside an accepted interval is suppressed. Independently, the places of the base phrases are
counted over words (runs of digits, letters and characters above ASCII).

Defined cases: a null text is an empty one; repeated rows get equal results each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.staging import text_batches
from kestrel.llm.textarrays import ALNUM, Words, slices

#: Base phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keyword that gates the rules and is part of every match, pattern of the license's name (lower case).
FAMILIES = (
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "bsd zero", r"bsd zero[- ]clause"),
    ("afl-3.0", "academic free", r"academic free license,?(?: version| v\.?)? ?3\.0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license,?(?: \(agpl\))?,?(?: version| v\.?)? ?3(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license"),
    ("apache-1.1", "apache", r"apache(?: software)? license,? (?:version |v\.? ?)?1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)? license,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("artistic-2.0", "artistic", r"artistic license,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("bsd-2-clause", "bsd", r"(?:2-clause bsd|bsd 2-clause|simplified bsd)(?: \"simplified\")?(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:3-clause bsd|bsd 3-clause|new bsd|modified bsd)(?: \"new\")?(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:4-clause bsd|bsd 4-clause|original bsd)(?: license)?"),
    ("bsd", "bsd", r"bsd(?:-style)? license"),
    ("bsl-1.0", "boost", r"boost software license(?:,? (?:version |v\.? ?)?1\.0)?"),
    ("busl-1.1", "business source", r"business source license(?:,? (?:version |v\.? ?)?1\.1)?"),
    ("cc-by-nc-nd-4.0", "cc by", r"cc by-nc-nd 4\.0"),
    ("cc-by-nc-sa-4.0", "cc by", r"cc by-nc-sa 4\.0"),
    ("cc-by-nc-4.0", "cc by", r"cc by-nc 4\.0"),
    ("cc-by-nd-4.0", "cc by", r"cc by-nd 4\.0"),
    ("cc-by-sa-4.0", "cc by", r"cc by-sa 4\.0"),
    ("cc-by-sa-3.0", "cc by", r"cc by-sa 3\.0"),
    ("cc-by-3.0", "cc by", r"cc by 3\.0"),
    ("cc-by-4.0", "cc by", r"cc by 4\.0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non-?commercial(?: 4\.0)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share-?alike(?: [34]\.0)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [34]\.0)?"),
    ("cc0-1.0", "cc0", r"cc0(?:[- ]1\.0)?(?: universal)?"),
    ("cddl-1.0", "common development", r"common development and distribution license"),
    ("cecill-2.1", "cecill", r"cecill(?: free software license agreement)?(?: v?2\.1)?"),
    ("cpl-1.0", "common public", r"common public license"),
    ("ecl-2.0", "educational community", r"educational community license"),
    ("elastic-2.0", "elastic", r"elastic license(?: 2\.0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license,?(?: -)? (?:version |v\.? ?)?1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public license,?(?: -)? (?:version |v\.? ?)?2\.0"),
    ("epl", "eclipse", r"eclipse public license"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e(?:,? (?:version |v\.? ?)?1\.2)?"),
    ("fdl-1.3", "free documentation", r"(?:gnu )?free documentation license(?:,? (?:version |v\.? ?)?1\.[0-3])?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license,? (?:version |v\.? ?)?3(?:\.0)?"),
    ("gpl-2.0", "gpl", r"gnu gpl,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("gpl-3.0", "gpl", r"gnu gpl,? (?:version |v\.? ?)?3(?:\.0)?"),
    ("gpl", "general public", r"(?:gnu )?general public license"),
    ("isc", "isc", r"isc license"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license,? (?:version |v\.? ?)?2(?:\.1)?"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license,? (?:version |v\.? ?)?3(?:\.0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public license"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public license"),
    ("lppl-1.3c", "latex", r"latex project public license"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?"),
    ("mit", "expat", r"expat license"),
    ("mit", "mit", r"mit(?:\s+|/x11 |-)license"),
    ("mpl-1.1", "mozilla", r"mozilla public license,? (?:version |v\.? ?)?1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public license,? (?:version |v\.? ?)?2(?:\.0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("ncsa", "illinois", r"university of illinois(?:/ncsa)?(?: open source)? license"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?:,? (?:version |v\.? ?)?1\.1)?"),
    ("openssl", "openssl", r"openssl license"),
    ("osl-3.0", "open software", r"open software license(?:,? (?:version |v\.? ?)?3\.0)?"),
    ("php-3.01", "php", r"php license(?:,? (?:version |v\.? ?)?3\.01)?"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("psf-2.0", "python software", r"python software foundation license(?:,? (?:version |v\.? ?)?2)?"),
    ("sspl-1.0", "server side", r"server side public license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("upl-1.0", "universal permissive", r"universal permissive license"),
    ("wtfpl", "do what the f", r"do what the f\w+ you want to public license"),
    ("x11", "x11", r"x11 license"),
    ("zlib", "zlib", r"zlib(?:/libpng)? license"),
    ("zpl-2.1", "zope", r"zope public license"),
)

#: Notices around a name, the strongest first: form, pattern with {} for the name, score.
FORMS = (
    ("tag", r"spdx-license-identifier:\s*{}(?:-only|-or-later)?(?![\w.-])", 1.0),
    ("grant", r"(?:licensed|released|distributed|published|made available|provided|available)\s+(?:to you\s+)?"
              r"under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?<!\w){}(?!\w)", 0.95),
    ("field", r"licen[cs]es?\s*[:=]\s*[\"']?(?:the\s+)?{}(?!\w)", 0.9),
    ("name", r"(?<!\w){}(?!\w)", 0.75),
)

#: White space that is not one blank.
WIDE = re.compile(r"\s{2,}|[^\S ]")


@dataclass(frozen=True)
class Signature:
    """A rule; a smaller ``priority`` is applied first."""

    priority: int
    label: str
    form: str
    keyword: str
    pattern: re.Pattern
    score: float


def signatures() -> list[Signature]:
    """All rules in order: every form of every family, strong forms and precise names first."""
    out = []
    for form, frame, score in FORMS:
        for label, keyword, name in FAMILIES:
            if form == "tag":  # tags carry the identifier itself
                name, keyword = re.escape(label), "spdx-license-identifier"
            out.append(Signature(len(out), label, form, keyword, re.compile(frame.format(f"(?:{name})")), score))
    return out


class Scanner:
    """Keyword prefilter and rules."""

    def __init__(self, rules: list[Signature]):
        self.by_keyword: dict[str, list[Signature]] = {}
        for r in rules:
            self.by_keyword.setdefault(r.keyword, []).append(r)
        self.automaton = ahocorasick.Automaton()
        for k in self.by_keyword:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[Signature, int, int]]:
        """Accepted detections (rule, start, end): by priority, contained intervals suppressed."""
        plain = WIDE.sub(" ", text)
        keywords = {k for _, k in self.automaton.iter(plain)}
        found = [(r, *m.span()) for k in keywords for r in self.by_keyword[k] for m in r.pattern.finditer(plain)]
        # a longer notice of the same form comes before a shorter one inside it
        found.sort(key=lambda x: (x[0].score < 0.9, x[1] - x[2], x[0].priority, x[1]))
        kept: list[tuple[Signature, int, int]] = []
        edge: list[tuple[int, int]] = []  # accepted intervals that no other contains, by start
        for r, a, b in found:
            if not _contained(edge, a, b):
                kept.append((r, a, b))
        kept.sort(key=lambda x: (x[1], x[2], x[0].priority))
        if len(plain) == len(text) or not kept:
            return kept
        origin = _origins(text)
        return [(r, origin(a), origin(b - 1) + 1) for r, a, b in kept]


def _origins(text: str) -> Callable[[int], int]:
    """Position in ``text`` of a character of its form with single blanks."""
    blank, shift, lost = [], [], 0
    for m in WIDE.finditer(text):
        blank.append(m.start() - lost)
        lost += m.end() - m.start() - 1
        shift.append(lost)
    return lambda p: p + (shift[at - 1] if (at := bisect_left(blank, p)) else 0)


def _contained(edge: list[tuple[int, int]], a: int, b: int) -> bool:
    """True if an interval of ``edge`` holds [a, b); else it is put in, in order of start."""
    at = bisect_right(edge, (a, 1 << 62))
    # intervals in ``edge`` do not contain each other, so their ends grow with their starts
    if at and edge[at - 1][1] >= b:
        return True
    inside = at
    while inside < len(edge) and edge[inside][1] <= b:
        inside += 1
    edge[at:inside] = [(a, b)]
    return False


def base_places(words: Words, phrases: tuple[tuple[str, str], ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each phrase: (text, word number in the text) of every place."""
    data, n = words.texts.data, len(words)
    size = words.end - words.start
    out = []
    for phrase, _ in phrases:
        parts = [p.encode() for p in phrase.split(" ")]
        at = np.arange(max(0, n - len(parts) + 1))
        at = at[words.doc[at] == words.doc[at + len(parts) - 1]] if len(at) else at
        for k, p in enumerate(parts):
            at = at[size[at + k] == len(p)]
            for j, letter in enumerate(p):
                at = at[data[words.start[at + k] + j] == letter]
        out.append((words.doc[at], at - words.first[words.doc[at]]))
    return out


_SCANNERS: list[Scanner] = []


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """License places and labels of every whole text.

    Returns (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    detections): ``detections`` lists the accepted (label, form, start, end) with character
    positions, ``score`` is that of the strongest detection (0 without any).
    """
    source = text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("label", pa.string()), ("form", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNERS:
            _SCANNERS.append(Scanner(signatures()))
        scanner = _SCANNERS[0]
        for batch in batches:
            for part, texts in slices(batch, "text"):
                low = texts.lower()
                words = Words(low, ALNUM)
                n = len(texts)
                base = base_places(words, BASE_PHRASES)
                doc = np.concatenate([d for d, _ in base])
                at = np.concatenate([p for _, p in base])
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, doc, at)
                np.maximum.at(last, doc, at)
                names: list[set] = [set() for _ in range(n)]
                for (d, _), (_, label) in zip(base, BASE_PHRASES):
                    for i in np.unique(d).tolist():
                        names[i].add(label)
                base_labels = [",".join(sorted(x)) for x in names]
                found = [scanner.detections(low.raw(i).decode()) for i in range(n)]
                labels = [",".join(sorted(x | {r.label for r, _, _ in f})) for x, f in zip(names, found)]
                score = [max((r.score for r, _, _ in f), default=0.5 if x else 0.0) for x, f in zip(names, found)]
                none = last < 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words.counts().astype(np.int64)),
                     pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                     pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base_labels), pa.array(labels),
                     pa.array(score, pa.float64()),
                     pa.array([[{"label": r.label, "form": r.form, "start": a, "end": b} for r, a, b in f] for f in found],
                              pa.list_(item))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                           "detections"])

    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, "
                                  "base_labels string, labels string, score double, "
                                  "detections array<struct<label:string,form:string,start:long,end:long>>")
