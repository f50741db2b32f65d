"""The operators inside Structured Streaming."""
