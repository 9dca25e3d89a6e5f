"""Readers and writers of ticks and bars."""
