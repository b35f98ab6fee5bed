"""Agent-trace analytics as PySpark DataFrame functions."""
