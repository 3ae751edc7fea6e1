"""Ordered micro-batches with state."""
