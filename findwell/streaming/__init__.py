"""Change feeds and usage statistics with Structured Streaming."""
