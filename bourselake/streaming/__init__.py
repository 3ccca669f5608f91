"""Structured Streaming forms of the bar, news and signal operators."""
