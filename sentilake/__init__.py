"""Aspect-level review sentiment as Spark DataFrame jobs."""

from sentilake.config import CleanConfig, FeatureConfig, TrainConfig
from sentilake.functions.lexicon import Lexicon

__all__ = ["CleanConfig", "FeatureConfig", "Lexicon", "TrainConfig"]
