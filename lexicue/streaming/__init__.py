"""Structured Streaming forms of the event-driven jobs. Stateless and windowed ones also run on batches."""
