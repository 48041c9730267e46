"""Structured Streaming forms of the event queries."""
