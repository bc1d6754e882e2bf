"""Structured Streaming: sources, windows, stateful operators and jobs."""
