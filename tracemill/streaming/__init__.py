"""streaming of the trace-analytics engine."""
