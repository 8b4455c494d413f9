"""Real-time operators on Structured Streaming."""
