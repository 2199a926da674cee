"""Readers and writers for tensor files, catalogs, logs and checkpoints."""
