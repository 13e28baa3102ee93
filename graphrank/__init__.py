"""Spark jobs that build, split, score, evaluate and explain links of typed graphs."""

__version__ = "0.1.0"
