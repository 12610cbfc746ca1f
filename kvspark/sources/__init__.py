"""Sources and sinks beyond Spark's own."""
