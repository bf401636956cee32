"""Operators for training data: quantile sketches, leakage of evaluation texts, source mixing, repetition."""
