"""SQL text builders for the DuckDB reference queries (the independent oracle).

They spell out, in plain SQL, the same definitions the Spark operators compute,
so the two engines can be compared on the same parquet tables.
"""

from __future__ import annotations

from kestrel.functions.text import stem_pairs


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def slug(x: str) -> str:
    c = f"lower(strip_accents({x}))"
    c = f"regexp_replace({c}, '([0-9]),([0-9])', '\\1\\2', 'g')"
    c = f"regexp_replace({c}, '([0-9]),([0-9])', '\\1\\2', 'g')"
    return f"trim(regexp_replace({c}, '[^a-z0-9]+', ' ', 'g'))"


def stem_map() -> str:
    return "MAP {" + ", ".join(f"{q(v)}: {q(h)}" for v, h in stem_pairs()) + "}"


def stem(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda t: coalesce({stem_map()}[t], t)), ' ')")


def windows(x: str, n: int) -> str:
    return (f"(CASE WHEN length({x}) >= {n} THEN list_transform(range(1, length({x}) - {n} + 2), "
            f"lambda i: substr({x}, i::INTEGER, {n})) ELSE []::VARCHAR[] END)")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def char_wb(x: str, n: int) -> str:
    p = "(' ' || w || ' ')"
    return (f"flatten(list_transform({words(x)}, lambda w: CASE WHEN length{p} <= {n} THEN [{p}] "
            f"ELSE {windows(p, n)} END))")


def char(x: str, n: int) -> str:
    return windows(f"regexp_replace({x}, '\\s\\s+', ' ', 'g')", n)


def word_tokens(x: str, min_len: int = 2) -> str:
    return f"regexp_extract_all(lower({x}), '[\\pL\\pN_]{{{min_len},}}')"


def word_ngrams(x: str, n: int, min_len: int = 2) -> str:
    toks = word_tokens(x, min_len)
    if n == 1:
        return toks
    return (f"(CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n} + 2), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)")


def grams(x: str, analyzer: str, n: int) -> str:
    if analyzer == "char_wb":
        return char_wb(f"lower({x})", n)
    if analyzer == "char":
        return char(f"lower({x})", n)
    return word_ngrams(x, n)


def tfidf_ctes(inputs_sql: str, matches_sql: str, analyzer: str = "char_wb", n: int = 3,
               use_stemmer: bool = True, smooth: bool = True, p: str = "") -> str:
    """CTEs ending in ``{p}wn(side, key, term, weight)``; the two inputs select a column ``key``."""
    txt = stem(slug("key")) if use_stemmer else slug("key")
    idf = "ln((nd.n + 1) / (df + 1)) + 1" if smooth else "ln(nd.n / df) + 1"
    return f"""
{p}inp AS (SELECT DISTINCT key FROM ({inputs_sql}) WHERE key IS NOT NULL),
{p}mat AS (SELECT DISTINCT key FROM ({matches_sql}) WHERE key IS NOT NULL),
{p}docs AS (SELECT 'i' AS side, key, {txt} AS txt FROM {p}inp
            UNION ALL SELECT 'm' AS side, key, {txt} AS txt FROM {p}mat),
{p}toks AS (SELECT side, key, unnest({grams('txt', analyzer, n)}) AS term FROM {p}docs),
{p}tf AS (SELECT side, key, term, count(*) AS tf FROM {p}toks GROUP BY side, key, term),
{p}dfq AS (SELECT term, count(*)::DOUBLE AS df FROM {p}tf GROUP BY term),
{p}w AS (SELECT side, key, tf.term, tf * ({idf}) AS w FROM {p}tf tf JOIN {p}dfq dfq ON tf.term = dfq.term
         CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM {p}docs) nd),
{p}wn AS (SELECT side, key, term, w / sqrt(sum(w * w) OVER (PARTITION BY side, key)) AS weight FROM {p}w)"""


def cosine_cte(p: str = "") -> str:
    return f"""{p}cos AS (SELECT a.key AS input, b.key AS match, round(sum(a.weight * b.weight), 4) AS score
        FROM {p}wn a JOIN {p}wn b ON a.term = b.term WHERE a.side = 'i' AND b.side = 'm' GROUP BY a.key, b.key
        HAVING round(sum(a.weight * b.weight), 4) > 0)"""


def topn_cte(n_top: int, p: str = "") -> str:
    return f"""{p}top AS (SELECT input, match, score, rank::INTEGER AS rank FROM (
        SELECT input, match, score, row_number() OVER (PARTITION BY input ORDER BY score DESC, match) AS rank
        FROM {p}cos) WHERE rank <= {n_top})"""


def tfidf_match_sql(inputs_sql: str, matches_sql: str, n_top: int = 5, **kw) -> str:
    return f"""WITH {tfidf_ctes(inputs_sql, matches_sql, **kw)},
{cosine_cte()}, {topn_cte(n_top)}
SELECT input, rank, match, score FROM top"""


def norm_key(parent: str, child: str) -> str:
    return f"lower(replace({parent}, ' ', '_') || '.' || replace({child}, ' ', '_'))"


def _char_counts(src: str) -> str:
    return (f"SELECT key, ch, count(*) AS c FROM (SELECT key, unnest(string_split(key, '')) AS ch FROM {src}) "
            f"GROUP BY key, ch")


TOKEN_FORMULA = {
    "Overlap": "x / least(na, nb)",
    "Cosine": "x / sqrt(na * nb)",
    "Jaccard": "x / (na + nb - x)",
    "Tversky": "x / (na + nb - x)",
    "Sorensen": "2 * x / (na + nb)",
}
EDIT_SQL = {
    "Levenshtein": "levenshtein(input, match)::DOUBLE",
    "DamerauLevenshtein": "damerau_levenshtein(input, match)::DOUBLE",
    "Jaro": "CASE WHEN input = match THEN 1.0 ELSE jaro_similarity(input, match) END",
    "JaroWinkler": "CASE WHEN input = match THEN 1.0 ELSE jaro_winkler_similarity(input, match) END",
    "Hamming": ("(SELECT count(*) FROM range(1, greatest(length(input), length(match)) + 1) r(i) "
                "WHERE substr(input, i::INTEGER, 1) IS DISTINCT FROM substr(match, i::INTEGER, 1))::DOUBLE"),
}


def textdist_sql(inputs_sql: str, terms_sql: str, algorithm: str, desc: bool, n_top: int = 5) -> str:
    """Brute-force all pairs (the oracle may be quadratic), rank, keep top n."""
    if algorithm in TOKEN_FORMULA:
        pairs = f"""ci AS ({_char_counts('i')}), cm AS ({_char_counts('m')}),
inter AS (SELECT ci.key AS a, cm.key AS b, sum(least(ci.c, cm.c)) AS x FROM ci JOIN cm ON ci.ch = cm.ch GROUP BY ci.key, cm.key),
p AS (SELECT i.key AS input, m.key AS match, coalesce(inter.x, 0)::DOUBLE AS x,
             length(i.key)::DOUBLE AS na, length(m.key)::DOUBLE AS nb
      FROM i CROSS JOIN m LEFT JOIN inter ON inter.a = i.key AND inter.b = m.key),
s AS (SELECT input, match, round(CASE WHEN input = match THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0
                                      ELSE {TOKEN_FORMULA[algorithm]} END, 4) AS score FROM p)"""
    else:
        pairs = f"""p AS (SELECT i.key AS input, m.key AS match FROM i CROSS JOIN m),
s AS (SELECT input, match, round({EDIT_SQL[algorithm]}, 4) AS score FROM p)"""
    order = "score DESC" if desc else "score"
    return f"""WITH i AS (SELECT DISTINCT key FROM ({inputs_sql}) WHERE key IS NOT NULL),
m AS (SELECT DISTINCT key FROM ({terms_sql}) WHERE key IS NOT NULL),
{pairs},
r AS (SELECT input, match, score, row_number() OVER (PARTITION BY input ORDER BY {order}, match) AS rank FROM s)
SELECT input, rank::INTEGER AS rank, match, score FROM r WHERE rank <= {n_top}"""
