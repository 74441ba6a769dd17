"""Time-to-event analytics on Spark tables."""
