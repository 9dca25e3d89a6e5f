"""Ordered, keyed operators: windows, as-of joins, runs, episodes, evaluation."""
