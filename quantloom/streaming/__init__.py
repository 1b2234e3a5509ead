"""Structured Streaming forms of the bar builder, clusters, cool-downs and indicators."""
