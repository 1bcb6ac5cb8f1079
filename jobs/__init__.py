"""Runnable jobs over the given tables."""
