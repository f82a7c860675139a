"""Veracity: a PySpark-native engine for judging question-answer text at data-set scale."""

__version__ = "0.1.0"
