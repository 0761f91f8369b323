"""Structured Streaming: feeds, limits, states, upserts."""
