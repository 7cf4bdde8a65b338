"""Structured Streaming: the same transforms on arriving documents, and windowed metrics."""
