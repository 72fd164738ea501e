"""Job parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class JobConfig:
    # Splits
    val_ratio: float = 0.1
    seed: int = 42
    holdout_ratio: float = 0.2
    holdout_val_share: float = 0.5
    # TF-IDF and linear classifier
    max_features: int = 50_000
    ngram_range: tuple[int, int] = (1, 2)
    reg_c: float = 1.0
    max_iter: int = 1000
    # Integer sequences and embedding classifier
    num_words: int = 5000
    max_len: int = 200
    embedding_dim: int = 128
    hidden_units: int = 64
    epochs: int = 9
    patience: int = 3
    epoch_iterations: int = 5  # optimiser iterations of one round of the perceptron
    embedding_parts: int = 8  # parallel learners of the word vectors, which are averaged; part of the model
    # WordPiece
    max_length: int = 256
    # Request limits
    text_min_chars: int = 1
    text_max_chars: int = 5000
    batch_max_texts: int = 32
    # Model choice
    default_model: str = "lstm"
