"""Loaders of documents, office files, evaluation sets; sinks."""
