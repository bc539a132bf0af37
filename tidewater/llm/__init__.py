"""Operators for building language-model training data at cluster scale."""
