"""functions of the trace-analytics engine."""
