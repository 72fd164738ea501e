"""Review text analytics as Spark jobs: clean, split, featurise, train, score, evaluate, report."""

from reviewlens.config import JobConfig

__all__ = ["JobConfig"]
