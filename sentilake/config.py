"""Job settings. Column names, cleaning flags, feature and training parameters."""

from __future__ import annotations

from dataclasses import dataclass

from sentilake.functions import fixed_words as words


@dataclass(frozen=True)
class CleanConfig:
    """How raw review text becomes model-ready text."""

    text_column: str = "text"
    label_column: str = "sentiment"
    output_column: str = "text_clean"
    id_column: str = "review_id"

    lowercase: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    remove_non_alpha: bool = True
    remove_stopwords: bool = True
    lemmatize: bool = True
    min_token_length: int = 2
    stop_words: tuple[str, ...] = words.STOP_WORDS
    # Column that maps a row's tokens to lemmas (``operators.lemmas.with_lemmas``); without it the default rule holds.
    lemma_map: str | None = None

    drop_empty_rows: bool = True
    deduplicate_on_text: bool = False


@dataclass(frozen=True)
class FeatureConfig:
    """Split and TF-IDF parameters."""

    id_column: str = "review_id"
    text_column: str = "text_clean"
    label_column: str = "sentiment"
    test_size: float = 0.2
    seed: int = 42
    stratify: bool = True
    max_features: int = 50_000
    ngram_min: int = 1
    ngram_max: int = 2
    min_df: int = 2
    max_df: float = 0.95


@dataclass(frozen=True)
class TrainConfig:
    """Model search parameters."""

    primary_metric: str = "f1_weighted"
    cv_folds: int = 3
    seed: int = 42
    # Most iterations of a fit. All fits that are not done share a pass over the training rows.
    logistic_iterations: int = 2000
    machine_iterations: int = 1000
    stochastic_iterations: int = 1000
    models: tuple[str, ...] = ("LogisticRegression", "LinearSVC", "MultinomialNB", "SGDClassifier")
