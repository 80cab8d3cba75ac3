"""operators of the trace-analytics engine."""
