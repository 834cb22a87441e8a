"""Structured Streaming: events, deltas and subscriptions."""
