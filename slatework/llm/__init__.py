"""Operators that prepare text, media and vectors for language-model training."""
