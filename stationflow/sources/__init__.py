"""Readers of trips, inventory snapshots, weather and station masters, and the table sinks."""
