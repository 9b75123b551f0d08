"""Streams of positions. An addition of this engine's own, on Structured Streaming's built-in operators."""
