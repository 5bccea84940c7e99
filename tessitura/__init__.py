"""Tessitura: PySpark operators for symbolic-music token data."""

__version__ = "0.1.0"
