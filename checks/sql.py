"""DuckDB fragments that state the same rules once more, in SQL."""

from __future__ import annotations

from sentilake.functions import fixed_words as words
from sentilake.functions.text import SPACE_CODES

from checks import fixtures


def quoted(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def has(items, token: str) -> str:
    return f"list_contains({quoted(items)}, {token})"


def normal(x: str) -> str:
    no_tags = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    no_urls = f"regexp_replace({no_tags}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    return f"trim(regexp_replace(lower({no_urls}), '[^a-z]+', ' ', 'g'))"


def unfused(x: str) -> str:
    a = f"regexp_replace({x}, '\\b(?:(can)(not)|(gim)(me)|(gon)(na))\\b', '\\1\\3\\5 \\2\\4\\6', 'g')"
    return f"regexp_replace({a}, '\\b(?:(got)(ta)|(lem)(me)|(wan)(na))\\b', '\\1\\3\\5 \\2\\4\\6', 'g')"


def lemma(t: str) -> str:
    table = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.IRREGULAR_NOUNS.items())
    return (
        f"CASE WHEN {has(words.IRREGULAR_NOUNS, t)} THEN CASE {t} {table} END "
        f"WHEN right({t}, 1) <> 's' OR length({t}) <= 3 OR {has(words.KEPT_NOUNS, t)} THEN {t} "
        f"WHEN right({t}, 3) = 'ies' THEN CASE WHEN length({t}) > 4 THEN left({t}, length({t}) - 3) || 'y' ELSE left({t}, length({t}) - 1) END "
        f"WHEN right({t}, 4) IN ('sses', 'ches', 'shes') OR right({t}, 3) IN ('xes', 'oes') "
        f"OR {has([w + 'es' for w in words.NOUNS_WITH_ES], t)} THEN left({t}, length({t}) - 2) "
        f"WHEN right({t}, 2) IN ('ss', 'us', 'is') THEN {t} ELSE left({t}, length({t}) - 1) END"
    )


def raw_tokens(x: str) -> str:
    return f"list_filter(string_split({unfused(normal(x))}, ' '), lambda t: t <> '' AND NOT {has(words.STOP_WORDS, 't')})"


def tokens(x: str) -> str:
    return f"list_filter(list_transform({raw_tokens(x)}, lambda t: {lemma('t')}), lambda t: length(t) >= 2)"


def blank(x: str) -> str:
    return f"NOT regexp_matches(coalesce({x}, ''), '[^\\s\\x1c-\\x1f\\x0b]')"


def clauses(x: str) -> str:
    # RE2 has no look-ahead: mark the full stop first, then cut at the mark.
    dots = f"regexp_replace(coalesce({x}, ''), '\\.(\\s+[A-Za-z])', chr(1) || '\\1', 'g')"
    cuts = f"regexp_replace({dots}, '(?i)\\b(?:{'|'.join(words.CLAUSE_CONNECTIVES)})\\b|[;!?]', chr(1), 'g')"
    spaces = " || ".join(f"chr({c})" for c in SPACE_CODES)
    return f"list_filter(list_transform(string_split({cuts}, chr(1)), lambda c: trim(c, {spaces})), lambda c: c <> '')"


def weight_case(t: str, weights: dict[str, float]) -> str:
    groups: dict[float, list[str]] = {}
    for word, value in weights.items():
        groups.setdefault(value, []).append(word)
    arms = " ".join(f"WHEN {has(g, t)} THEN {v}" for v, g in groups.items())
    return f"CAST(CASE {arms} ELSE 1.0 END AS DOUBLE)"


def cue_sum(toks: str, cues, weights) -> str:
    hits = f"list_filter({toks}, lambda t: {has(cues, 't')})"
    return f"coalesce(list_sum(list_transform({hits}, lambda t: {weight_case('t', weights)})), CAST(0 AS DOUBLE))"


def positive_sum(toks: str) -> str:
    return cue_sum(toks, words.POSITIVE_CUES, words.POSITIVE_WEIGHTS)


def negative_sum(toks: str) -> str:
    return cue_sum(toks, words.NEGATIVE_CUES, words.NEGATIVE_WEIGHTS)


def signal(toks: str) -> str:
    return f"list_has_any({toks}, {quoted((*words.POSITIVE_CUES, *words.NEGATIVE_CUES))})"


def forced(toks: str) -> str:
    groups = " OR ".join(f"list_has_all({toks}, {quoted(g)})" for g in words.FORCED_NEGATIVE_GROUPS)
    return (
        f"CASE WHEN list_has_any({toks}, {quoted(words.FORCED_NEGATIVE_ANY)}) THEN CAST(0.82 AS DOUBLE) "
        f"WHEN {groups} THEN CAST(0.72 AS DOUBLE) END"
    )


def feature(clause: str, toks: str, number: str) -> str:
    """Aspect name of a clause; written as a scalar over two candidate lists."""
    first = (
        f"list_filter(regexp_extract_all(lower({clause}), '[a-z]+'), lambda t: NOT {has(words.STOP_WORDS, 't')} "
        f"AND NOT {has(words.BANNED_ASPECT_TOKENS, 't')} AND length(t) >= 3 AND right(t, 2) <> 'ly')"
    )
    second = f"list_filter({toks}, lambda t: NOT {has(words.BANNED_ASPECT_TOKENS, 't')} AND length(t) >= 3)"
    chosen = f"CASE WHEN len({first}) > 0 THEN {first} ELSE {second} END"
    return (
        f"coalesce(list_filter({chosen}, lambda t: {has(words.BUG_FEATURES, 't')})[-1], "
        f"list_filter({chosen}, lambda t: {has(words.PREFERRED_FEATURES, 't')})[-1], "
        f"({chosen})[-1], 'aspect_' || {number})"
    )


# ---- common table expressions ------------------------------------------------------------


def unit_ctes(source: str, key: str, x: str = "text") -> str:
    """``units``: signal clauses of every row of ``source`` with feature and rule columns."""
    return f"""clause_rows AS (
  SELECT {key}, unnest({clauses(x)}) AS evidence, generate_subscripts({clauses(x)}, 1) AS unit FROM {source}),
clause_tokens AS (SELECT {key}, CAST(unit AS INT) AS unit, evidence, {tokens('evidence')} AS toks FROM clause_rows),
units AS (
  SELECT {key}, unit, evidence, toks, {feature('evidence', 'toks', 'unit')} AS feature,
    {forced('toks')} AS forced, {positive_sum('toks')} AS ps, {negative_sum('toks')} AS ns
  FROM clause_tokens WHERE {signal('toks')})"""


def terms_of(toks: str) -> str:
    return (
        f"list_concat({toks}, list_transform(range(1, len({toks})), "
        f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]))"
    )


def corpus_ctes(rows: str = "SELECT * FROM corpus") -> str:
    """``vocab`` and ``nbw`` (naive Bayes weights, alpha 0.1) fitted on the labelled documents."""
    return f"""corpus AS ({fixtures.CORPUS}),
chosen AS ({rows}),
cleaned AS (SELECT doc_id, sentiment, toks FROM (SELECT doc_id, sentiment, {tokens('text')} AS toks FROM chosen) WHERE len(toks) > 0),
doc_terms AS (SELECT doc_id, sentiment, term, count(*) AS cnt
  FROM (SELECT doc_id, sentiment, unnest({terms_of('toks')}) AS term FROM cleaned) GROUP BY ALL),
n_docs AS (SELECT count(*) AS n FROM cleaned),
vocab AS (
  SELECT *, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS idx FROM (
    SELECT term, df, tf, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf
    FROM (SELECT term, count(*) AS df, CAST(sum(cnt) AS BIGINT) AS tf FROM doc_terms GROUP BY term), n_docs
    WHERE df >= 2 AND df <= CAST(0.95 AS DOUBLE) * n
    ORDER BY tf DESC, term LIMIT 50000)),
x AS (
  SELECT doc_id, sentiment, term, idx, cnt, cnt * idf / sqrt(sum(cnt * idf * cnt * idf) OVER (PARTITION BY doc_id)) AS tfidf
  FROM doc_terms JOIN vocab USING (term)),
sums AS (
  SELECT term, coalesce(sum(tfidf) FILTER (sentiment = 'negative'), 0) AS n0,
    coalesce(sum(tfidf) FILTER (sentiment = 'positive'), 0) AS n1
  FROM vocab LEFT JOIN x USING (term) GROUP BY term),
totals AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS size FROM sums),
priors AS (SELECT ln(count(*) FILTER (sentiment = 'negative') / CAST(count(*) AS DOUBLE)) AS b0,
  ln(count(*) FILTER (sentiment = 'positive') / CAST(count(*) AS DOUBLE)) AS b1 FROM cleaned),
nbw AS (
  SELECT term, idf, ln((n0 + CAST(0.1 AS DOUBLE)) / (t0 + CAST(0.1 AS DOUBLE) * size)) AS w0,
    ln((n1 + CAST(0.1 AS DOUBLE)) / (t1 + CAST(0.1 AS DOUBLE) * size)) AS w1
  FROM sums JOIN vocab USING (term), totals)"""


def score_ctes(key: str, source: str, name: str = "scored_units") -> str:
    """Class scores and probabilities of (key, unit, toks) rows."""
    return f"""{name}_terms AS (
  SELECT {key}, unit, term, count(*) AS cnt
  FROM (SELECT {key}, unit, unnest({terms_of('toks')}) AS term FROM {source}) GROUP BY ALL),
{name}_sums AS (
  SELECT {key}, unit, sum(cnt * idf * w0) / sqrt(sum(cnt * idf * cnt * idf)) AS s0,
    sum(cnt * idf * w1) / sqrt(sum(cnt * idf * cnt * idf)) AS s1
  FROM {name}_terms JOIN nbw USING (term) GROUP BY ALL),
{name} AS (
  SELECT u.*, coalesce(s0, 0) + b0 AS z0, coalesce(s1, 0) + b1 AS z1,
    1 / (1 + exp((coalesce(s1, 0) + b1) - (coalesce(s0, 0) + b0))) AS p0,
    1 / (1 + exp((coalesce(s0, 0) + b0) - (coalesce(s1, 0) + b1))) AS p1,
    CASE WHEN coalesce(s1, 0) + b1 > coalesce(s0, 0) + b0 THEN 'positive' ELSE 'negative' END AS label
  FROM {source} u LEFT JOIN {name}_sums USING ({key}, unit), priors)"""


def overall(label: str, confidence: str, p: str, n: str) -> str:
    return (
        f"CASE WHEN {confidence} < CAST(0.6 AS DOUBLE) THEN 'neutral' "
        f"WHEN abs({p} - {n}) < CAST(1 AS DOUBLE) - CAST(0.6 AS DOUBLE) THEN 'neutral' ELSE {label} END"
    )


def ruled(label: str, p: str, n: str, forced_col: str = "forced", ps: str = "ps", ns: str = "ns") -> str:
    """``sentiment, positive, negative`` after the clause rules."""
    low = "CAST(0.7 AS DOUBLE)"
    down = f"({forced_col} IS NOT NULL OR {ns} > {ps})"
    floor = f"greatest({n}, coalesce({forced_col}, {low}))"
    return f"""CASE WHEN {down} THEN 'negative' WHEN {ps} > {ns} THEN 'positive'
    WHEN greatest({p}, {n}) < CAST(0.6 AS DOUBLE) THEN 'neutral' ELSE {label} END AS sentiment,
  CASE WHEN {down} THEN 1 - {floor} WHEN {ps} > {ns} THEN greatest({p}, {low}) ELSE {p} END AS positive,
  CASE WHEN {down} THEN {floor} WHEN {ps} > {ns} THEN 1 - greatest({p}, {low}) ELSE {n} END AS negative"""


def review_ctes() -> str:
    """``whole`` and ``points``: the fixture reviews scored with the naive Bayes model."""
    return f"""{corpus_ctes()},
reviews AS ({fixtures.REVIEWS}),
texts AS (SELECT review_id, coalesce(text, '') AS text, {tokens('text')} AS toks, 0 AS unit FROM reviews),
{unit_ctes('texts', 'review_id')},
{score_ctes('review_id', 'texts', 'scored_texts')},
whole AS (
  SELECT *, CASE WHEN {blank('text')} THEN 'Input sentence cannot be empty.'
    WHEN len(toks) = 0 THEN 'Sentence became empty after preprocessing. Provide richer text.' END AS error,
    greatest(p0, p1) AS confidence, {overall('label', 'greatest(p0, p1)', 'p1', 'p0')} AS overall
  FROM scored_texts),
{score_ctes('review_id', 'units', 'scored_units')},
points AS (SELECT review_id, unit, feature, evidence, {ruled('label', 'p1', 'p0')} FROM scored_units)"""
