"""The station-hour count and the event run as Structured Streaming queries."""
