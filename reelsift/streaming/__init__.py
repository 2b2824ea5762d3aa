"""Structured Streaming twins (see ``reelsift.streaming.jobs``)."""
