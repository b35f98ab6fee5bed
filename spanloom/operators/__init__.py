"""DataFrame -> DataFrame operators over the trace tables."""
