"""Longer jobs composed from operators: training, scoring, evaluation."""
