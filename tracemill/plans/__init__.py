"""plans of the trace-analytics engine."""
