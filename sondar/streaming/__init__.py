"""Structured Streaming: scoring of token streams with late data and state."""

from sondar.streaming.monitor import alerts, windowed_scores

__all__ = ["alerts", "windowed_scores"]
