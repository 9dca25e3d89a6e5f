"""State machines that run in batch and in Structured Streaming with one step function."""
