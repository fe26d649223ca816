"""Structured Streaming forms of the analytics (an extension of this engine)."""
