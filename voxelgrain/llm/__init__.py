"""Operators for text corpora: run reports, manifests and other documents prepared as training data."""
