"""Structured Streaming: tailing source, batch sink, stateful processors."""
