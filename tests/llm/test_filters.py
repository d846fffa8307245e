"""Ops 5, 7, 8 and 9 against brute force."""

import hashlib
import random
import re
from itertools import product
from re import _parser

from kestrel.llm.cascade import BASE, RULES, quality_cascade
from kestrel.llm.licenses import BASE_PHRASES, FAMILIES, Scanner, scan_licenses, signatures
from kestrel.llm.urlrules import filter_urls
from kestrel.llm.winnow import contamination_digest, decontaminate
from tests.llm.cases import documents, frame, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOW))


def contamination(rows, items, span=13):
    out = []
    for doc_id, text, *_ in rows:
        w, hit, names = alnum(text), set(), set()
        for name, item in items:
            own = alnum(item)
            n = min(span, len(own))
            for q in range(len(own) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p: p + n] == own[q: q + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name) if name is not None else "")
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rows, rng = documents(), random.Random(8)
    texts = {i: t for i, t, *_ in rows if i is not None}
    cut = texts[2].split(" ")
    items = [(1, " ".join(cut[40:60])), (2, " ".join(cut[40:52])), (3, " ".join(cut[50:63]) + " zz"), (4, "ONE, two; three"),
             (5, None), (6, ""), (7, words(rng, 40)), (8, texts[1]), (None, "naïve 🙂 ÄÖ é"), (9, "x " * 30), (1, words(rng, 3)),
             (10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination_digest(decontaminate(frame(spark, rows), bench))
    assert sorted(map(tuple, got.collect()), key=str) == contamination(rows, items)
    for span, k in ((6, 2), (9, 9)):
        got = contamination_digest(decontaminate(frame(spark, rows), bench, span=span, k=k))
        assert sorted(map(tuple, got.collect()), key=str) == contamination(rows, items, span)
    none = contamination_digest(decontaminate(frame(spark, rows), bench.limit(0)))
    assert sorted(map(tuple, none.collect()), key=str) == contamination(rows, [])
    assert decontaminate(frame(spark, []), bench).count() == 0


def test_url_rules(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
             ("allow", "tie.org", "/a"), ("block", "tie.org", "/a"), ("block", "tie.org", "/a"), (None, "x", "/")]
    urls = ["http://a.net/", "http://a.net", "https://EXAMPLE.net/en/1?q=/", "https://b.example.net/en", "x://example.com/de/?x",
            "http://myexample.com/de/", "http://q.org/fr/a#b", None, "", "no scheme", "http:///path", "http://tie.org/ab",
            "http://net/", "a://b://net/", "http://example.com?/de/", "http://user@a.net:80/", "http://a.net/\nx"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(1, urls[1]), (None, urls[0])]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOW)
        fits = [(-len(h + p), a != "block", h + p, a) for a, h, p in rules
                if a and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    df = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    assert sorted(map(tuple, filter_urls(df, table).collect()), key=str) == sorted(((i, *judge(u)) for i, u in pages), key=str)
    assert filter_urls(df.limit(0), table).count() == 0
    assert {r["verdict"] for r in filter_urls(df, table.limit(0)).collect()} == {"allow"}


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = {}
    for p in range(len(w) - 7):
        grams.setdefault(tuple(w[p: p + 8]), []).append(p)
    repeat = {q for at in grams.values() if len(at) > 1 for p in at for q in range(p, p + 8)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z\u0080-\U0010ffff]", text))
    n, chars, symbols, dup, _ = counts
    failed = n < 20 or 100 * len(repeat) > 30 * n
    bad = 2 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 20 * n or 4 * letters < chars \
        or 10 * upper > 7 * max(letters, 1)
    return (*counts, failed, not (failed or bad))


def test_quality(spark):
    rng = random.Random(2)
    rows = documents() + [(100 + i, " ".join(rng.choice(["##", "AB", "ab", "1", "\n", "cd\nab", "é"]) for _ in range(60)), "", "", 0)
                          for i in range(40)]
    got = quality_cascade(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", *BASE, "base_failed", "kept").collect()), key=str) \
        == sorted(((i, *quality(t)) for i, t, *_ in rows), key=str)
    for order in (RULES, RULES[::-1]):
        other = quality_cascade(frame(spark, rows), rules=order)
        assert sorted((str(r["doc_id"]), r["kept"]) for r in other.collect()) == sorted((str(i), quality(t)[-1]) for i, t, *_ in rows)
    assert all((r["rejected_by"] is None) == r["kept"] for r in got.collect())
    assert quality_cascade(frame(spark, [])).count() == 0


def test_license_base(spark):
    texts = ["The MIT License (MIT)\nmit-license", None, "", "submit license", "apache   license general public license 日 mit license",
             "GNU General Public License, version 3. SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0.", "mit" * 900]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(0, texts[0], "", "", 0)]

    def base(text):
        w, at, labels = alnum(text), [], set()
        for phrase, label in BASE_PHRASES:
            p = phrase.split(" ")
            for i in range(len(w) - len(p) + 1):
                if w[i: i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    got = sorted(scan_licenses(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got] \
        == sorted((i, *base(t)) for i, t, *_ in rows)
    labels = {r["doc_id"]: r["labels"].split(",") for r in got}
    assert labels[6] == ["cc-by-nc-4.0"] and {"gpl", "gpl-3.0", "apache-2.0"} <= set(labels[5]) and labels[3] == [""]
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} for r in got)
    assert scan_licenses(frame(spark, [])).count() == 0


def test_license_suppression_brute_force():
    rules = signatures()
    assert len(rules) > 200
    scanner, rng = Scanner(rules), random.Random(4)
    pieces = ["licensed under the apache license, version 2.0", "mit license", "gnu general public license, version 3", "cc by-nc 4.0",
              "license: mit license", "bsd license", " and ", ".", "word", "spdx-license-identifier: mit", "released under the mit license"]
    for _ in range(200):
        text = " ".join(rng.choice(pieces) for _ in range(8))
        found = [(r, *m.span()) for r in rules if r.keyword in text for m in r.pattern.finditer(text)]
        found.sort(key=lambda x: (x[0].score < 0.9, x[1] - x[2], x[0].priority, x[1]))
        kept = []
        for r, a, b in found:
            if not any(x <= a and b <= y for _, x, y in kept):
                kept.append((r, a, b))
        assert scanner.detections(text) == sorted(kept, key=lambda x: (x[1], x[2], x[0].priority))


def spelled(parsed):
    """Texts of a pattern: every alternative, each optional part with and without, one character of a class."""
    def one(op, arg):
        kind = str(op)
        if kind == "LITERAL":
            return [chr(arg)]
        if kind == "IN":
            return [chr(v) if str(k) == "LITERAL" else "0" if str(k) == "RANGE" else {"CATEGORY_SPACE": " "}.get(str(v), "x") for k, v in arg]
        if kind == "MAX_REPEAT":
            return [x * n for n in {arg[0], max(arg[0], 1)} for x in spelled(arg[2])]
        if kind == "BRANCH":
            return [x for branch in arg[1] for x in spelled(branch)]
        if kind == "SUBPATTERN":
            return spelled(arg[3])
        assert kind == "ANY", kind
        return ["x"]

    return ["".join(x) for x in product(*(one(*item) for item in parsed))]


def test_license_keywords():
    """Every text of every name contains the keyword that gates its rules, also when its blanks are wide."""
    scanner = Scanner(signatures())
    for label, keyword, name in FAMILIES:
        for text in spelled(_parser.parse(name)):
            assert re.fullmatch(name, text) and keyword in text, (label, text)
            for gap in (" ", "\n", "\r\n\t  "):
                wide = "a  b\n" + text.replace(" ", gap) + "\n c"
                found = scanner.detections(wide)
                assert [(a, b) for _, a, b in found] == [(5, len(wide) - 3)], (label, wide, found)


def test_license_white_space(spark):
    texts = ["GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "Apache License\n   Version 2.0, January 2004",
             "under the Mozilla Public\nLicense", "a BSD\nlicense", "Creative\n  Commons Attribution 4.0", "BSD Zero Clause License",
             "BSD Zero-Clause", "released under\n\tthe  terms of the\nISC\u00a0\u2028license.", "mit\t license"]
    want = ["gpl,gpl-3.0", "apache,apache-2.0", "mpl", "bsd", "cc-by", "0bsd", "0bsd", "isc", "mit"]
    cut = ["GNU GENERAL PUBLIC LICENSE\n                       Version 3", "Apache License\n   Version 2.0", "Mozilla Public\nLicense",
           "BSD\nlicense", "Creative\n  Commons Attribution 4.0", "BSD Zero Clause", "BSD Zero-Clause", texts[7][:-1], "mit\t license"]
    got = scan_licenses(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == want
    assert [[t[d["start"]: d["end"]] for d in r["detections"]] for t, r in zip(texts, got)] == [[x] for x in cut]
