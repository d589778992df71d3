"""Entity maps on Structured Streaming."""
