"""Text functions as native column expressions: cleaning, tokens, clauses, terms.

Patterns carry ``(?U)`` wherever white space or word borders are meant in the
Unicode sense, so that e.g. a connective inside an accented word is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.functions import fixed_words as words
from sentilake.functions import lists

DEFAULT = CleanConfig()

# --- fixed values: patterns and the white-space alphabet ---
HTML_TAG = r"<[^>]+>"
URL = r"(?U)https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+"
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
NON_BLANK = r"(?U)[^\s\x1c-\x1f]"
CLAUSE_BORDER = r"(?iU)\b(?:" + "|".join(words.CLAUSE_CONNECTIVES) + r")\b|[;!?]|\.(?=\s+[A-Z])"
FUSED_WORD = r"\b(?:" + "|".join(rf"{a}(?={b}\b)" for a, b in words.FUSED_WORDS) + ")"
SPACE_CODES = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))


def as_text(col: Column) -> Column:
    """Any value as a string, null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def is_blank(col: Column) -> Column:
    """True for text that is null, empty or white space only."""
    return ~as_text(col).rlike(NON_BLANK)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def normalize(col: Column, cfg: CleanConfig = DEFAULT) -> Column:
    """Tags, URLs, case, non-letters and runs of white space; no token work yet."""
    x = as_text(col)
    if cfg.remove_html:
        x = F.regexp_replace(x, HTML_TAG, " ")
    if cfg.remove_urls:
        x = F.regexp_replace(x, URL, " ")
    if cfg.lowercase:
        x = F.lower(x)
    if cfg.remove_non_alpha:
        # "anything but letters and white space" followed by "collapse white space"
        # is one replacement of every run of non-letters.
        x = F.regexp_replace(x, "[^a-z]+" if cfg.lowercase else "[^a-zA-Z]+", " ")
    else:
        x = F.regexp_replace(x, WHITESPACE_RUN, " ")
    return F.trim(x)


def lemma() -> str:
    """Default noun lemma of ``t``: listed nouns, then plural endings. Endings that single nouns share are cut for listed words only."""
    table = " ".join(f"WHEN '{noun}' THEN '{base}'" for noun, base in words.IRREGULAR_NOUNS.items())
    long_plurals = [f"{noun}es" for noun in words.NOUNS_WITH_ES]

    def cut(n: int) -> str:
        return f"substring(t, 1, length(t) - {n})"

    return f"""CASE
        WHEN NOT endswith(t, 's') AND NOT {lists.one_of(w for w in words.IRREGULAR_NOUNS if not w.endswith('s'))} THEN t
        WHEN {lists.one_of(words.IRREGULAR_NOUNS)} THEN CASE t {table} END
        WHEN length(t) <= 3 OR {lists.one_of(words.KEPT_NOUNS)} THEN t
        WHEN endswith(t, 'ies') THEN CASE WHEN length(t) > 4 THEN concat({cut(3)}, 'y') ELSE {cut(1)} END
        WHEN endswith(t, 'sses') OR endswith(t, 'ches') OR endswith(t, 'shes') OR endswith(t, 'xes') OR endswith(t, 'oes')
            OR {lists.one_of(long_plurals)} THEN {cut(2)}
        WHEN endswith(t, 'ss') OR endswith(t, 'us') OR endswith(t, 'is') THEN t
        ELSE {cut(1)} END"""


def raw_tokens(col: Column, cfg: CleanConfig = DEFAULT) -> Column:
    """Tokens of the normalized text with stop words removed, before lemma and length."""
    tokens = F.split(F.regexp_replace(normalize(col, cfg), FUSED_WORD, "$0 "), " ")
    dropped = ["", *cfg.stop_words] if cfg.remove_stopwords else [""]
    return lists.keep(tokens, f"NOT {lists.one_of(dropped)}")


def clean_tokens(col: Column, cfg: CleanConfig = DEFAULT) -> Column:
    """Cleaned tokens: stop words out, then lemma, then the length test, in that order."""
    tokens = raw_tokens(col, cfg)
    if cfg.lemmatize:
        tokens = lists.change(tokens, lemma() if cfg.lemma_map is None else f"coalesce(try_element_at(`{cfg.lemma_map}`, t), t)")
    return lists.keep(tokens, f"length(t) >= {int(cfg.min_token_length)}")


def clean_text(col: Column, cfg: CleanConfig = DEFAULT) -> Column:
    """Cleaned tokens joined by one space."""
    return F.array_join(clean_tokens(col, cfg), " ")


def split_clauses(col: Column) -> Column:
    """Trimmed non-blank clauses in text order."""
    return F.filter(F.transform(F.split(as_text(col), CLAUSE_BORDER), strip), lambda c: c != "")


def letter_runs(col: Column) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(col), F.lit("([a-z]+)"), F.lit(1))


def text_tokens(text_clean: Column) -> Column:
    """White-space tokens of already cleaned text."""
    return F.filter(F.split(text_clean, " "), lambda t: t != "")


def ngram_terms(tokens: Column, ngram_min: int = 1, ngram_max: int = 2) -> Column:
    """Word n-grams of a token array. Tokens of one character take no part."""
    if not 1 <= ngram_min <= ngram_max <= 2:
        raise ValueError("ngram range must lie within 1..2")
    kept = F.filter(tokens, lambda t: F.length(t) >= 2)
    parts = []
    if ngram_min == 1:
        parts.append(kept)
    if ngram_max == 2:
        # zip the array with itself shifted by one; no captured column inside the lambda,
        # so the token expression is evaluated once per row.
        shifted = F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0)))
        heads = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        parts.append(F.zip_with(heads, shifted, lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]
