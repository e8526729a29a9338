"""Clause units and aspect names as array expressions over one review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentilake.config import CleanConfig
from sentilake.functions import lists, rules, text
from sentilake.functions.lexicon import Lexicon


def first_choice_tokens(clause: Column, cfg: CleanConfig, lexicon: Lexicon) -> Column:
    """Raw clause words that may name an aspect."""
    dropped = (*cfg.stop_words, *lexicon.banned_aspect_tokens) if cfg.remove_stopwords else lexicon.banned_aspect_tokens
    return lists.keep(
        text.letter_runs(clause), f"length(t) >= 3 AND NOT endswith(t, 'ly') AND NOT {lists.one_of(dropped)}"
    )


def second_choice_tokens(tokens: Column, lexicon: Lexicon) -> Column:
    """Cleaned clause words that may name an aspect when the raw words give none."""
    return lists.keep(tokens, f"length(t) >= 3 AND NOT {lists.one_of(lexicon.banned_aspect_tokens)}")


def pick_feature(candidates: Column, clause_no: Column, lexicon: Lexicon) -> Column:
    """Last bug word, else last preferred feature, else last word, else ``aspect_n``."""
    last = F.lit(-1)
    return F.coalesce(
        F.try_element_at(lists.keep(candidates, lists.one_of(lexicon.bug_features)), last),
        F.try_element_at(lists.keep(candidates, lists.one_of(lexicon.preferred_features)), last),
        F.try_element_at(candidates, last),
        F.concat(F.lit("aspect_"), clause_no.cast("string")),
    )


def clause_units(col: Column, cfg: CleanConfig, lexicon: Lexicon) -> Column:
    """Clauses with a sentiment cue: array of (unit, feature, evidence, tokens, rule).

    ``unit`` is the 1-based clause number, counting clauses without a cue. Each step
    binds its intermediate arrays to a lambda variable, so nothing is evaluated twice.
    """
    numbered = F.transform(
        text.split_clauses(col),
        lambda c, i: F.struct(
            (i + 1).cast("int").alias("unit"), c.alias("evidence"), text.clean_tokens(c, cfg).alias("tokens")
        ),
    )
    signal = F.filter(numbered, lambda u: lexicon.has_signal(u["tokens"]))
    named = F.transform(
        signal,
        lambda u: F.struct(u.alias("u"), first_choice_tokens(u["evidence"], cfg, lexicon).alias("first")),
    )
    chosen = F.transform(
        named,
        lambda n: F.struct(
            n["u"].alias("u"),
            F.when(F.size(n["first"]) > 0, n["first"])
            .otherwise(second_choice_tokens(n["u"]["tokens"], lexicon))
            .alias("candidates"),
        ),
    )
    return F.transform(
        chosen,
        lambda n: F.struct(
            n["u"]["unit"].alias("unit"),
            pick_feature(n["candidates"], n["u"]["unit"], lexicon).alias("feature"),
            n["u"]["evidence"].alias("evidence"),
            n["u"]["tokens"].alias("tokens"),
            rules.clause_rule(n["u"]["tokens"], lexicon).alias("rule"),
        ),
    )
