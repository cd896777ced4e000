"""Readers of raw logs, documents, manifests, run logs and run metrics."""
