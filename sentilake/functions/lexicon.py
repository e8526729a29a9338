"""Sentiment lexicon: cue words, weights, forced rules, aspect word lists."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentilake.functions import fixed_words as words
from sentilake.functions import lists

# A lexicon is written into the plan as literals, so its size is checked.
MAX_LEXICON_WORDS = 20_000

CUE_SCHEMA = "word string, polarity string, weight double"
GROUP_SCHEMA = "group_id int, word string, group_size int"


@dataclass(frozen=True)
class Lexicon:
    """Word lists and scalars used by the sentiment and aspect rules."""

    positive_cues: tuple[str, ...] = words.POSITIVE_CUES
    negative_cues: tuple[str, ...] = words.NEGATIVE_CUES
    positive_weights: Mapping[str, float] = None  # type: ignore[assignment]
    negative_weights: Mapping[str, float] = None  # type: ignore[assignment]
    forced_negative_any: tuple[str, ...] = words.FORCED_NEGATIVE_ANY
    forced_negative_pairs: tuple[tuple[str, ...], ...] = words.FORCED_NEGATIVE_GROUPS
    forced_negative_score: float = words.FORCED_NEGATIVE_SCORE
    forced_pair_negative_score: float = words.FORCED_GROUP_NEGATIVE_SCORE
    neutral_confidence_threshold: float = words.NEUTRAL_CONFIDENCE_THRESHOLD
    banned_aspect_tokens: tuple[str, ...] = words.BANNED_ASPECT_TOKENS
    preferred_features: tuple[str, ...] = words.PREFERRED_FEATURES
    bug_features: tuple[str, ...] = words.BUG_FEATURES

    def __post_init__(self) -> None:
        if self.positive_weights is None:
            object.__setattr__(self, "positive_weights", dict(words.POSITIVE_WEIGHTS))
        if self.negative_weights is None:
            object.__setattr__(self, "negative_weights", dict(words.NEGATIVE_WEIGHTS))
        total = sum(len(v) for v in self.__dict__.values() if hasattr(v, "__len__"))
        if total > MAX_LEXICON_WORDS:
            raise ValueError(f"Lexicon has {total} entries; at most {MAX_LEXICON_WORDS} are allowed.")

    @classmethod
    def fallback(cls) -> Lexicon:
        """The four-plus-four cue lexicon used when a lexicon file is unusable."""
        return cls(
            positive_cues=words.FALLBACK_POSITIVE_CUES,
            negative_cues=words.FALLBACK_NEGATIVE_CUES,
            positive_weights={},
            negative_weights={},
            forced_negative_any=(),
            forced_negative_pairs=(),
            banned_aspect_tokens=(),
            preferred_features=(),
            bug_features=(),
        )

    def override(self, entries: Mapping[str, Any]) -> Lexicon:
        """Replace whole top-level entries; names that are no entry are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: _entry(k, v) for k, v in entries.items() if k in known})

    # ---- relational form -------------------------------------------------------------

    def cue_rows(self) -> list[tuple[str, str, float]]:
        """(word, polarity, weight); a cue without a weight counts 1.0."""
        return [
            *((w, "positive", float(self.positive_weights.get(w, 1.0))) for w in dict.fromkeys(self.positive_cues)),
            *((w, "negative", float(self.negative_weights.get(w, 1.0))) for w in dict.fromkeys(self.negative_cues)),
        ]

    def cue_table(self, spark: SparkSession) -> DataFrame:
        """Cue words as a table. Its size is bounded by ``MAX_LEXICON_WORDS``."""
        return spark.createDataFrame(self.cue_rows(), CUE_SCHEMA)

    def group_table(self, spark: SparkSession) -> DataFrame:
        """Forced-negative word groups, one row per word."""
        rows = [
            (i, w, len(set(group)))
            for i, group in enumerate(self.forced_negative_pairs)
            for w in dict.fromkeys(group)
        ]
        return spark.createDataFrame(rows, GROUP_SCHEMA)

    # ---- column form -----------------------------------------------------------------

    def has_signal(self, tokens: Column) -> Column:
        """True when any token is a positive or negative cue."""
        return lists.any_of(tokens, lists.one_of((*self.positive_cues, *self.negative_cues)))

    def cue_sum(self, tokens: Column, polarity: str) -> Column:
        """Summed cue weights of one polarity, repeats counted, added in token order."""
        cues, weights = (
            (self.positive_cues, self.positive_weights)
            if polarity == "positive"
            else (self.negative_cues, self.negative_weights)
        )
        by_weight: dict[float, list[str]] = {}
        for word, weight in weights.items():
            by_weight.setdefault(float(weight), []).append(word)
        arms = " ".join(f"WHEN {lists.one_of(group)} THEN {weight!r}D" for weight, group in by_weight.items())
        weight_of = f"CASE {arms} ELSE 1.0D END" if arms else "1.0D"
        return lists.total(lists.keep(tokens, lists.one_of(cues)), weight_of)

    def forced_score(self, tokens: Column) -> Column:
        """Floor of the negative score if a forced word or word group is present, else null."""
        single = lists.any_of(tokens, lists.one_of(self.forced_negative_any))
        group = reduce(
            lambda a, b: a | b,
            [
                reduce(lambda a, b: a & b, [F.array_contains(tokens, w) for w in dict.fromkeys(g)], F.lit(True))
                for g in self.forced_negative_pairs
            ],
            F.lit(False),
        )
        return F.when(single, F.lit(float(self.forced_negative_score))).when(
            group, F.lit(float(self.forced_pair_negative_score))
        )


def read_lexicon(spark: SparkSession, path: str, base: Lexicon | None = None) -> Lexicon:
    """Read a small JSON (or, if a YAML parser is present, YAML) lexicon file.

    The file is read whole. Entries found in it replace those of ``base``. A file that is missing,
    unparsable or not a mapping yields ``base`` (by default the fallback lexicon) with a warning; any other
    failure, a missing YAML parser included, is raised.
    """
    base = base or Lexicon.fallback()
    try:
        found = spark.read.text(path, wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return _defaults(path, "does not exist", base)
    try:
        parsed = _parse_mapping(path, found.value if found else "")
    except ValueError as error:
        return _defaults(path, f"cannot be parsed ({error})", base)
    return base.override(parsed) if isinstance(parsed, Mapping) else _defaults(path, "holds no mapping", base)


def _defaults(path: str, reason: str, base: Lexicon) -> Lexicon:
    warnings.warn(f"The lexicon file {path} {reason}; the default entries are used.", stacklevel=3)
    return base


def _parse_mapping(path: str, text: str) -> Any:
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(str(error)) from error
    return json.loads(text)


def _entry(name: str, value: Any) -> Any:
    if name.endswith("_weights"):
        return {str(k): float(v) for k, v in (value or {}).items()}
    if name == "forced_negative_pairs":
        return tuple(tuple(w for w in g if isinstance(w, str)) for g in value or ())
    if name.endswith(("_score", "_threshold")):
        return float(value)
    return tuple(w for w in value or () if isinstance(w, str))
