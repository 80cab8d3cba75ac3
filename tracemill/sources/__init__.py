"""sources of the trace-analytics engine."""
