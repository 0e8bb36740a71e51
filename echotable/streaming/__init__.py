"""Structured Streaming forms of the live-window and monitoring operators."""
