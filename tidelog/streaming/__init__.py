"""Structured Streaming forms of the timeline, of extraction and of alerting."""
