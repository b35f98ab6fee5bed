"""Readers and writers: captured pairs, hooks, compactions, prices, exports."""
