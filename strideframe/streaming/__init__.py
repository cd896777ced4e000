"""Incremental work: new sessions only, in batches or as a file stream."""
