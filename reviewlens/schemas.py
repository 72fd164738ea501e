"""Explicit schemas; nothing in this package infers one."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEWS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

REVIEW_CSV = T.StructType([
    T.StructField("review", T.StringType()),
    T.StructField("sentiment", T.StringType()),
])

CLASS_SCORES = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("support", T.LongType()),
])

# One wide nullable row for every model tier; each tier fills its own part.
METRICS = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("train_accuracy", T.DoubleType()),
    T.StructField("train_f1", T.DoubleType()),
    T.StructField("val_accuracy", T.DoubleType()),
    T.StructField("val_f1", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("test_f1", T.DoubleType()),
    T.StructField("test_loss", T.DoubleType()),
    T.StructField("training_time_seconds", T.DoubleType()),
    T.StructField("vocab_size", T.LongType()),
    T.StructField("max_features", T.IntegerType()),
    T.StructField("ngram_range", T.ArrayType(T.IntegerType())),
    T.StructField("C", T.DoubleType()),
    T.StructField("epochs_completed", T.IntegerType()),
    T.StructField("num_words", T.IntegerType()),
    T.StructField("max_len", T.IntegerType()),
    T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("hidden_units", T.IntegerType()),
    T.StructField("lstm_units", T.IntegerType()),
    T.StructField("dropout_rate", T.DoubleType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("num_epochs", T.IntegerType()),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("classification_report", T.MapType(T.StringType(), CLASS_SCORES)),
])
