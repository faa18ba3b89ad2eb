"""Structured Streaming forms of the change-log and monitoring operators."""
