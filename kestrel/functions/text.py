"""Column builders for text normalisation and tokenisation.

Everything here returns a ``Column`` made of built-in Spark expressions
(higher-order array functions, regexes), so it stays inside whole-stage
codegen and needs no Python worker.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Abbreviation dictionary of the glossary matcher.
# head word -> variants that are rewritten to it. Kept in its natural order.
# The head "asset" appears twice in the original dictionary; the later entry
# ({"assets"}) is the one in force, so "ast" is not a variant. The head " "
# (a blank) removes currency tokens.
# ---------------------------------------------------------------------------
STEMMER: dict[str, tuple[str, ...]] = {
    "account": ("acc", "accounts", "accounting"),
    "accrued": ("acrd",),
    "accrual": ("accruals",),
    "adjustment": ("adjustments",),
    "administration": ("administrations",),
    "aggregate": ("aggregated", "aggregation"),
    "agreement": ("agreemen", "agreem"),
    "asset": ("assets",),
    "amortised": ("amortized",),
    "amount": ("amounts", "amt"),
    "analytic": ("analytical",),
    "application": ("appl",),
    "associate": ("assoc", "association", "associating"),
    "authorised": ("authorized",),
    "authorisation": ("autorization",),
    "balance": ("balances", "bal"),
    "bank": ("bankb", "banks"),
    "benefit": ("benefits",),
    "binding": ("bind",),
    "cancellation": ("cancelation",),
    "ceiling": ("ceilling",),
    "class": ("classes",),
    "close": ("closed",),
    "code": ("cod",),
    "collateral": ("coll",),
    "commitment": ("commitments",),
    "component": ("components",),
    "compromise": ("compromised",),
    "condition": ("conditions",),
    "confirm": ("conf", "confirmation", "confirmed"),
    "construction": ("constr",),
    "contamination": ("contam", "contaminated"),
    "correction": ("corrected",),
    "contractual": ("ctr",),
    "current": ("curent", "crt"),
    "customer": ("custome", "cust", "customers"),
    "date": ("dt",),
    "database": ("databases", "db"),
    "day": ("days",),
    "decease": ("deceased",),
    "deferred": ("defered",),
    "deposit": ("deposits", "depo"),
    "disbursement": ("disbursment",),
    "discount": ("discounted",),
    "display": ("disp",),
    "document": ("documents",),
    "eligible": ("elig", "eligibility", "eligbility"),
    "enforce": ("enforcement",),
    "enterprise": ("enterprises",),
    "entity": ("entities",),
    "equity": ("equities",),
    "establish": ("established",),
    "evaluation": ("eval",),
    "expense": ("expenses",),
    "exposure": ("exposures", "exp"),
    "external": ("ext",),
    "facility": ("facilities",),
    "family": ("familly",),
    "fee": ("fe",),
    "financial": ("fin", "financed", "finan", "finance", "financing"),
    "flag": ("flags", "flg"),
    "forced": ("forces",),
    "forex": ("fx",),
    "frequency": ("freq",),
    "fund": ("funds", "funding"),
    "gross": ("grs",),
    "guarantee": ("guar", "guaranteed", "guarantor"),
    "haircut": ("hcut",),
    "hedge": ("hedging",),
    "hierarchy": ("hier",),
    "high": ("higher",),
    "holding": ("holdings",),
    "hour": ("hours",),
    "identifier": ("id", "identity", "identif", "identification"),
    "ifrs": ("ifrs9",),
    "indicator": ("indicators", "indication"),
    "individual": ("individuals",),
    "ineligibility": ("inelig",),
    "information": ("info",),
    "inherited": ("inheritence",),
    "initial": ("init", "initiating", "initiation"),
    "installment": ("instalment", "installments", "instalments"),
    "instrument": ("instruments",),
    "insurance": ("insured", "insurer"),
    "interest": ("int",),
    "invest": ("investor", "investment", "investors"),
    "issue": ("issuer", "issued", "issuing"),
    "letter": ("letters",),
    "liability": ("liab",),
    "liquidity": ("liq",),
    "list": ("listed",),
    "loan": ("loans",),
    "local": ("loc", "locality", "location"),
    "loss": ("losses",),
    "market value": ("fva",),
    "material": ("matl", "materiality"),
    "maximum": ("max",),
    "measure": ("measurement", "measurements"),
    "member": ("members",),
    "minimum": ("min", "minim"),
    "modify": ("modified", "modification"),
    "month": ("monthly",),
    "national": ("nat",),
    "normalized": ("normalization",),
    "operating": ("oper", "operation", "operational", "operations", "operative"),
    "option": ("opt",),
    "organization": ("org", "organisational", "organisation"),
    "original": ("orig", "originated", "origination", "origin"),
    "other": ("oth",),
    "outstanding": ("outs", "os"),
    "overdue": ("ovd",),
    "owner": ("own", "ownership"),
    "parameter": ("parameters",),
    "payment": ("payments",),
    "penalty": ("pen",),
    "person": ("personal", "personality", "personnel", "persons"),
    "political": ("politic",),
    "postponed": ("posponed", "pospn"),
    "previous": ("prev",),
    "principal": ("prin",),
    "product": ("products",),
    "professional": ("profesional",),
    "program": ("programme",),
    "provision": ("provisions", "provisioning"),
    "prudential": ("prud",),
    "purchase": ("purchased",),
    "quantity": ("qty",),
    "rate": ("rt",),
    " ": ("eur", "lcy", "ocy"),
    "rating": ("ratings",),
    "reason": ("reasons",),
    "receive": ("received", "receiving"),
    "reclassify": ("reclassified", "reclassification"),
    "reconcile": ("reconciled", "reconciliation"),
    "recover": ("recovered", "recovery"),
    "reference": ("referance", "referenced"),
    "register": ("registered", "registration", "registry"),
    "reject": ("rejection",),
    "relation": ("rel", "related", "relations", "relationship"),
    "release": ("released",),
    "renew": ("renewal", "renewed", "renewable"),
    "repay": ("repayment",),
    "replacement": ("replacements",),
    "residence": ("residency", "residents"),
    "sale": ("sales",),
    "schema": ("scheme",),
    "secure": ("secured",),
    "segment": ("segmentation",),
}


def stem_pairs() -> list[tuple[str, str]]:
    """(variant, head) rows; a token that is itself a head is never rewritten."""
    heads = set(STEMMER)
    return [(v, h) for h, vs in STEMMER.items() for v in vs if v not in heads]


def _accent_table() -> tuple[str, str]:
    """Single-character transliteration for Latin letters, derived by rule
    (Unicode canonical decomposition, keep the ASCII base letter)."""
    src, dst = [], []
    for code in chain(range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if ord(c) < 128)
        if len(base) == 1 and base.isalpha():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENT_SRC, _ACCENT_DST = _accent_table()
# letters that transliterate to two characters or whose base is not a combining form
_MULTI = [("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"), ("Þ", "TH"), ("þ", "th"),
          ("Ø", "O"), ("ø", "o"), ("Đ", "D"), ("đ", "d"), ("Ł", "L"), ("ł", "l"), ("ı", "i")]


def slugify(col: Column | str) -> Column:
    """Lower-case ASCII slug with words separated by one blank.

    Latin letters are transliterated; other scripts become separators (no
    full Unicode transliteration exists among Spark's built-in functions).
    Thousands separators between digits are dropped, as a slug does.
    """
    c = F.col(col) if isinstance(col, str) else col
    for a, b in _MULTI:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.lower(F.translate(c, _ACCENT_SRC, _ACCENT_DST))
    c = F.regexp_replace(c, r"(?<=\d),(?=\d)", "")
    c = F.regexp_replace(c, r"[^a-z0-9]+", " ")
    return F.trim(c)


def stem_map_column() -> Column:
    pairs = stem_pairs()
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def stem(col: Column | str) -> Column:
    """Rewrite each blank-separated token through the abbreviation dictionary."""
    c = F.col(col) if isinstance(col, str) else col
    m = stem_map_column()
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a lambda variable (a lambda body
    would otherwise re-evaluate a captured expression for every array element)."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def _windows(s: Column, n: int) -> Column:
    """All substrings of length n, in order; empty when s is shorter than n."""
    def body(x):
        ln = F.length(x)
        return F.when(ln >= n, F.transform(F.sequence(F.lit(1), ln - n + 1), lambda i: F.substring(x, i, n))) \
            .otherwise(F.array().cast("array<string>"))
    return let(s, body)


def words(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def char_wb_ngrams(col: Column | str, n: int) -> Column:
    """Character n-grams inside word boundaries: each word padded with one blank on
    each side; a padded word not longer than n yields itself once."""
    padded = F.transform(words(col), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda p: F.when(F.length(p) <= n, F.array(p)).otherwise(_windows(p, n))))


def char_ngrams(col: Column | str, n: int) -> Column:
    """Character n-grams over the whole text after collapsing blank runs."""
    c = F.col(col) if isinstance(col, str) else col
    return _windows(F.regexp_replace(c, r"\s\s+", " "), n)


# a word character: letter, digit or underscore (any script)
WORD_CHAR = r"[\p{L}\p{N}_]"


def word_tokens(col: Column | str, min_len: int = 2) -> Column:
    """Maximal runs of word characters of at least ``min_len``, lower-cased."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_CHAR + "{" + str(min_len) + ",}"), 0)


def word_ngrams(col: Column | str, n: int, min_len: int = 2) -> Column:
    toks = word_tokens(col, min_len)
    if n == 1:
        return toks

    def body(tk):
        k = F.size(tk)
        return F.when(k >= n, F.transform(F.sequence(F.lit(1), k - n + 1),
                                          lambda i: F.array_join(F.slice(tk, i, n), " "))) \
            .otherwise(F.array().cast("array<string>"))
    return let(toks, body)


def analyzer_ngrams(col: Column | str, analyzer: str, n: int) -> Column:
    if analyzer == "char_wb":
        return char_wb_ngrams(F.lower(F.col(col) if isinstance(col, str) else col), n)
    if analyzer == "char":
        return char_ngrams(F.lower(F.col(col) if isinstance(col, str) else col), n)
    if analyzer == "word":
        return word_ngrams(col, n)
    raise ValueError("analyzer must be one of 'word', 'char', 'char_wb'")


def cleaned_char_ngrams(col: Column | str, n: int = 3) -> Column:
    """Character n-grams after dropping the characters , - . / and any blank followed by 'BD'."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"[,\-./]|\sBD", "")
    return _windows(c, n)


def qgrams(col: Column | str, q: int) -> Column:
    """Sequence used by the distance measures: words for q=0, characters for q=1,
    overlapping q-character grams otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    if q <= 0:
        return words(c)
    if q == 1:
        return F.filter(F.split(c, ""), lambda x: x != "")
    return _windows(c, q)
