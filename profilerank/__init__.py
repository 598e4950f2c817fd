"""Spark-native scoring, ranking and explanation of nested profile records."""

from profilerank.rules import Rules
from profilerank.vocabulary import Vocabulary

__all__ = ["Rules", "Vocabulary"]
